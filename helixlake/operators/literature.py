"""Literature operators over articles (id, title, abstract, source): merge, keywords, sorting, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import text as x
from helixlake.session import cut, small
from helixlake.sources import constants as k

#: Share of the texts from which a word of a query is common.
COMMON = 0.05


def union_sources(*tables: DataFrame) -> DataFrame:
    """Connector results one after the other, ``arrival`` numbering the connectors."""
    out = None
    for n, t in enumerate(tables):
        own = t.withColumn("arrival", F.lit(n))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def merge_unique(articles: DataFrame, *keys: str) -> DataFrame:
    """The first article by (arrival, id) of each key, the lower case of the first of ``keys`` that isn't blank."""
    key = F.lower(F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in keys]))
    n = F.row_number().over(Window.partitionBy("_key").orderBy("arrival", "id"))
    return articles.withColumn("_key", key).withColumn("_n", n).where("_n = 1").drop("_key", "_n")


def image_dedup(images: DataFrame, most: int = 8) -> DataFrame:
    """The first image of each 20 leading letters of its title, at most ``most``."""
    n = F.row_number().over(Window.partitionBy(F.substring(F.lower("title"), 1, 20)).orderBy("id"))
    return images.withColumn("_n", n).where("_n = 1").drop("_n").orderBy("id").limit(most)


def keywords(articles: DataFrame, top: int = 12) -> DataFrame:
    """(id, word, kind): title words, acronyms, the most frequent abstract words, hyphenated words.

    Words are cleaned of other signs; title words need 4 characters, frequent ones 5, and stop words go.
    """
    stop = F.array(*map(F.lit, k.STOP_WORDS))
    clean = lambda w: F.regexp_replace(w, r"[^a-zA-Z0-9\-]", "")
    title = F.filter(F.transform(F.split("title", r"\s+"), clean), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, F.lower(w)))
    acronyms = F.regexp_extract_all("abstract", F.lit(r"\b([A-Z][A-Z0-9]{1,9})\b"), F.lit(1))
    hyphens = F.filter(F.slice(F.regexp_extract_all("abstract", F.lit(r"\b([a-zA-Z]+-[a-zA-Z]+(?:-[a-zA-Z]+)?)\b"), F.lit(1)), 1, 8), lambda w: F.length(w) > 5)
    kinds = ((title, "title"), (acronyms, "acronym"), (hyphens, "hyphenated"), (_words("abstract"), "frequent"))
    own = articles.select("id", "title", "abstract").repartition("id")  # texts are dealt once, words stay where they are
    each = own.select("id", F.explode(F.array(*[F.struct(w.alias("words"), F.lit(n).alias("kind")) for w, n in kinds])).alias("l")).select("id", F.explode("l.words").alias("word"), "l.kind")
    n = each.groupBy("id", "kind", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where((F.col("kind") != "frequent") | (F.col("rank") <= top)).select("id", "word", "kind")


def _words(text) -> Column:
    """Lower-case words of 5 characters or more that are no stop words; other signs are taken out of the whole text at once."""
    clean = F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\-\s]", ""))
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 4) & ~w.isin(*k.STOP_WORDS))


def frequent_words(articles: DataFrame, top: int = 12) -> DataFrame:
    """(id, word, n, rank): an abstract's most frequent words of 5 characters or more, ties by the word."""
    n = articles.select("id", F.explode(_words("abstract")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)


def corpus_words(articles: DataFrame, top: int = 12) -> DataFrame:
    """The corpus' most frequent words by the number of articles they are in."""
    w = articles.select(F.explode(F.array_distinct(_words("abstract"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def sort_articles(articles: DataFrame, mode: str, limit: int) -> DataFrame:
    """By citations, year or title, a total order by id; a top-k."""
    order = {"citations": F.desc_nulls_last("citations"), "year": F.desc_nulls_last("year"), "title": F.asc(F.lower("title"))}[mode]
    return articles.orderBy(order, "id").limit(limit)


def source_counts(articles: DataFrame) -> DataFrame:
    """(source, n, n_titled): articles per source."""
    return articles.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("title") > 0).alias("n_titled"))


def by_source(evidence: DataFrame, block: int = 1024) -> DataFrame:
    """(source, block, ids): evidence grouped by source, ids in order; a source's ids are cut into blocks of ``block`` successive numbers."""
    own = evidence.withColumn("source", x.label(F.col("source"), "Unlabeled source")).withColumn("block", F.expr(f"id div {block}"))
    return own.groupBy("source", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def tsv_links(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name) of lines ``id<TAB>name``, the id without its prefix, and the columns to ``keep``; other lines are left out."""
    line = rows.select(*keep, F.explode(F.split(text, "\n")).alias("line")).where(F.contains("line", F.lit("\t")))
    parts = F.split("line", "\t")
    return line.select(*keep, F.regexp_replace(F.trim(parts[0]), "^[a-z]+:", "").alias("id"), F.trim(parts[1]).alias("name"))


def evidence_for(query_words: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    """(query, id, score, rank): evidence by how many of a query's words its text has, at most 12; ties to the smaller id.

    Words that over ``COMMON`` of the texts have find nothing by themselves: a text that shares no other word has at most as many of
    them as the query. Texts that share a rarer one are scored by all words, and where the last of the wanted ones has more than
    that, no other text can come before it. The queries for which it hasn't meet the common words too.
    """
    k = max(1, min(limit, 12))
    w = cut(query_words.select("query", F.explode("words").alias("word")).distinct())
    asked = small(w.select("word").distinct())
    e = cut(evidence.select("id", F.explode(F.array_distinct(F.split(x.normalise(F.col("text")), " "))).alias("word")).join(asked, "word", "left_semi"))
    n = evidence.where("text IS NOT NULL").select("id").distinct().count()
    common = e.groupBy("word").agg(F.count("*").alias("texts")).where(F.col("texts") > max(COMMON * n, k)).select("word")
    common = cut(common)
    met = cut(w.join(common, "word", "left_anti").join(e, "word").groupBy("query", "id").agg(F.count("*").alias("rare")))
    often = e.join(common, "word", "left_semi").join(met.select("id").distinct(), "id", "left_semi")
    shared = met.select("query", "id").join(often, "id").join(w, ["query", "word"], "left_semi").groupBy("query", "id").agg(F.count("*").alias("often"))
    score = (F.col("rare") + F.coalesce("often", F.lit(0))).alias("score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = lambda s: s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = cut(top(met.join(shared, ["query", "id"], "left").select("query", "id", score)))
    most = w.join(common, "word", "left_semi").groupBy("query").agg(F.count("*").alias("most"))
    last = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_ = cut(most.join(last, "query", "left").where(F.coalesce("least", F.lit(0)) <= F.col("most")).select("query"))
    rest = top(w.join(open_, "query", "left_semi").join(e, "word").groupBy("query", "id").agg(F.count("*").alias("score")))
    return first.join(open_, "query", "left_anti").unionByName(rest)
