"""Pages rendered from the documents, for the queries on pages.

Every text as HTML, with a menu, a footer, links to neighbouring documents and
links in the other forms of HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import pipes


def _escaped(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def _line(s: Column) -> Column:
    cells = F.replace(_escaped(s), F.lit(" | "), F.lit("</td><td>"))
    return (
        F.when(s.startswith("[CODE]: "), F.concat(F.lit("<pre>"), _escaped(s.substr(F.lit(9), F.length(s))), F.lit("</pre>")))
        .when(pipes(s) >= 2, F.concat(F.lit("<table><tr><td>"), cells, F.lit("</td></tr></table>")))
        .when(s == "", F.lit(""))
        .otherwise(F.concat(F.lit("<p>"), _escaped(s), F.lit("</p>")))
    )


def rendered(documents: DataFrame) -> DataFrame:
    """``doc_id, url, html`` of documents with an address and a text."""
    docs = documents.where("url IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = docs.select("doc_id", F.col("url").alias("target"))
    following = ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("target").alias("after"))
    below = (
        ids.where("doc_id > 1")
        .groupBy(F.floor(F.col("doc_id") / 2).alias("doc_id"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "target"))).alias("below"))
    )
    body = F.array_join(F.transform(F.split("text", "\n"), _line), "\n")

    def link(target: Column) -> Column:
        return F.concat(F.lit('<a href="'), target, F.lit('/">'), target, F.lit("</a>"))

    after = F.coalesce(link(F.col("after")), F.lit(""))
    children = F.array_join(F.transform(F.coalesce("below", F.array().cast("array<struct<doc_id:bigint,target:string>>")), lambda x: link(x["target"])), "")
    # links in the other forms of HTML, inside a part that has no text of the page
    i = F.col("doc_id").cast("string")
    variants = F.concat(
        F.lit("<footer><A CLASS=x HREF='../up/"), i, F.lit("?a=1&amp;b=2'>up</A><a title=\"a > b\" href = /plain-"), i, F.lit(">plain</a><a href=\"/f-"), i,
        F.lit('.pdf">file</a><a href="javascript:go()">go</a><!-- <a href="/hidden">x</a> --><a href="&#47;num-&eacute;/./a/../'), i, F.lit('">n</a></footer>'),
    )
    shell = F.when(F.col("lang").isNull(), '<div id="root"></div>').otherwise("")
    html = F.concat(
        F.lit("<html><head><title>"), F.col("doc_id").cast("string"), F.lit('</title></head><body><nav><a href="/">Home</a> <a href="mailto:desk">Desk</a></nav>'),
        shell, body, after, children, variants, F.lit('<footer><a href="#top">Top</a></footer></body></html>'),
    )
    return docs.join(following, "doc_id", "left").join(below, "doc_id", "left").select("doc_id", "url", html.alias("html"))
