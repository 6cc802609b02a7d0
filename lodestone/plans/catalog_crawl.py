"""Registered queries of crawl cleaning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables
from .registry import Registry
from ..functions import text
from ..operators import crawl, dense, html
from ..operators.html import Part, Scope
from .catalog_text import quoted, ws

r = Registry()

DENY = ["/es/", "spam-farm", "utm_source", ".html"]
PATHS = ["/en/", "/de/"]
NEWS_PATHS = ["/fr/"]
NEWS_WORDS = ["page=", "blog"]
RULES = [("/en/", "english"), ("/(?:de|fr)/", "european"), ("", "other")]
DOMAINS = ["example.com", "tionsh.example.net", "example.org"]


def sql_any(expression: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quoted(n)})" for n in needles) + ")"


HOST = r"lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"


@r.query(f"SELECT page_id, url FROM pages WHERE NOT {sql_any('lower(url)', DENY)}")
def url_filter(spark, sf_dir):
    return tables.pages(spark, sf_dir).filter(~crawl.denied("url", DENY)).select("page_id", "url")


@r.query(f"""
    SELECT page_id, CASE WHEN contains(lower(url), 'sitemap') THEN true WHEN {sql_any('lower(url)', DENY)} THEN false
           WHEN {sql_any('url', PATHS)} THEN true
           WHEN {sql_any('lower(url)', NEWS_PATHS)} AND {sql_any('lower(url)', NEWS_WORDS)} THEN true ELSE false END AS kept
    FROM pages""")
def url_cascade(spark, sf_dir):
    return tables.pages(spark, sf_dir).select(
        "page_id", crawl.accepted("url", DENY, PATHS, NEWS_PATHS, NEWS_WORDS).alias("kept")
    )


@r.query("""
    SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(?:de|fr)/') THEN 'european'
           ELSE 'other' END AS route FROM pages""")
def url_route(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", crawl.route("url", RULES).alias("route"))


@r.query(f"""
    SELECT page_id, {HOST} AS host FROM pages
    WHERE {' OR '.join(f"{HOST} = '{d}' OR ends_with({HOST}, '.{d}')" for d in DOMAINS)}""")
def url_hosts(spark, sf_dir):
    pages = tables.pages(spark, sf_dir).filter(crawl.on_domains("url", DOMAINS))
    return pages.select("page_id", crawl.host("url").alias("host"))


def sql_unescape(expression: str) -> str:
    for entity, character in html.ENTITIES:
        expression = f"replace({expression}, {quoted(entity)}, {quoted(character)})"
    return expression


def sql_strip_tags(expression: str) -> str:
    return ws(sql_unescape(f"regexp_replace({expression}, '<[^>]*>', ' ', 'g')"))


def sql_drop(expression: str, tags: list[str]) -> str:
    expression = f"regexp_replace({expression}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in tags:
        expression = rf"regexp_replace({expression}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return expression


def sql_container(tag: str) -> str:
    cleaned = sql_drop("html", ["script", "style", "iframe"])
    return sql_strip_tags(rf"regexp_extract({cleaned}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1)")


TITLE = ws(
    r"array_to_string(list_transform(regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1), lambda x: "
    + sql_strip_tags("x") + "), ' ')"
)


@r.query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", html.flat_title("html").alias("title"))


@r.query(f"SELECT page_id, {sql_container('article')} AS text_content FROM pages")
def page_main_text(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", html.flat_text("html", "article").alias("text_content"))


@r.query(f"SELECT page_id, url, {sql_container('main')} AS text_content FROM pages WHERE length({sql_container('main')}) > 0 UNION ALL SELECT page_id, url, {sql_container('article')} FROM pages WHERE length({sql_container('article')}) > 0")
def page_nonempty(spark, sf_dir):
    """Records of two routes, each without its empty pages."""
    pages = tables.pages(spark, sf_dir)
    parts = [
        pages.select("page_id", "url", html.flat_text("html", tag).alias("text_content")).filter(F.length("text_content") > 0)
        for tag in ("main", "article")
    ]
    return parts[0].unionByName(parts[1])


def sql_body() -> str:
    cleaned = sql_drop(r"regexp_extract(html, '(?is)<body>(.*?)(?:</body>|$)', 1)", ["script", "style", "iframe", "nav", "footer"])
    return sql_strip_tags(rf"regexp_replace({cleaned}, '(?is)<div class=\"ad\">.*?</div>', ' ', 'g')")


@r.query(f"SELECT page_id, {sql_body()} AS text_content FROM pages")
def page_scoped_text(spark, sf_dir):
    """Body text without navigation, footer and the ``ad`` class, by nested scopes."""
    scope = Scope((Part("body"),), (
        Part("script"), Part("style"), Part("iframe"), Part("nav"), Part("footer"), Part("div", ("ad",)),
    ))
    pages = tables.pages(spark, sf_dir).select("page_id", F.col("page_id").cast("string").alias("url"), "html")
    found = html.extract(pages, {"text_content": scope})
    return found.select(
        F.col("url").cast("bigint").alias("page_id"),
        text.normalize_ws(F.coalesce("text_content", F.lit(""))).alias("text_content"),
    )


DIM = 64
r.fragments.add("page_buckets", rf"""
    SELECT page_id, bucket, count(*)::DOUBLE AS n FROM (
        SELECT page_id, (('0x' || substr(md5(unnest(regexp_extract_all(lower({TITLE}), '\p{{L}}+'))), 1, 8))::BIGINT % {DIM}) AS bucket
        FROM pages) GROUP BY ALL""")
r.fragments.add("page_hashed", "SELECT page_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY page_id)) AS w FROM page_buckets")
r.fragments.add("topic_buckets", rf"""
    SELECT item_id, bucket, count(*)::DOUBLE AS n FROM (
        SELECT item_id, (('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\p{{L}}+'))), 1, 8))::BIGINT % {DIM}) AS bucket
        FROM benchmark) GROUP BY ALL""")
r.fragments.add("topic_hashed", "SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM topic_buckets")


@r.query("""
    SELECT page_id, url FROM pages WHERE page_id IN (
        SELECT page_id FROM (SELECT page_id, item_id, sum(p.w * t.w) AS cosine FROM page_hashed p JOIN topic_hashed t USING (bucket)
                             GROUP BY ALL) WHERE round(2 - 2 * cosine, 6) <= 1.3)""")
def topical_pages(spark, sf_dir):
    """Pages whose title is close to one of the benchmark passages, by hashed vectors."""
    pages = tables.pages(spark, sf_dir)
    titles = pages.select("page_id", html.flat_title("html").alias("title"))
    page_vectors = dense.hashed_vectors(titles, "page_id", "title", DIM)
    topics = dense.hashed_vectors(tables.questions(spark, sf_dir), "question_id", "question", DIM)
    return crawl.select_topical(pages, page_vectors, topics.withColumnRenamed("question_id", "topic_id"), 0.35).select(
        "page_id", "url"
    )
