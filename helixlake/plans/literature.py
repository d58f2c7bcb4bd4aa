"""Literature, text and sequence queries."""

from pyspark.sql import functions as F

from helixlake.functions import sequence as s
from helixlake.functions import text as x
from helixlake.operators import literature as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r
from helixlake.sources import constants as k
from helixlake.sources import views as v


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOP = _list(k.STOP_WORDS)
_CLEAN = "lower(regexp_replace(w, '[^a-zA-Z0-9\\-]', '', 'g'))"
_FREQ = f"words AS (SELECT id, {_CLEAN} AS word FROM (SELECT id, unnest(regexp_split_to_array(abstract, '\\s+')) AS w FROM articles)), freq AS (SELECT id, word, count(*) AS n FROM words WHERE length(word) > 4 AND NOT list_contains({_STOP}, word) GROUP BY ALL), frequent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word)::INTEGER AS rank FROM freq) WHERE rank <= 12)"


@query(f"WITH {v.ARTICLES} SELECT id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(CASE WHEN title <> '' THEN title ELSE id::VARCHAR END) ORDER BY id % 3, id) AS n FROM articles) WHERE n = 1")
def literature_dedup(spark, sf_dir):
    a = v.articles(spark, sf_dir)
    parts = [a.where(F.col("id") % 3 == i) for i in range(3)]
    return op.merge_unique(op.union_sources(*parts), "title", "id").select("id", "title", "source")


@query(f"WITH {v.ARTICLES} SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY substr(lower(title), 1, 20) ORDER BY id) AS n FROM articles) WHERE n = 1 ORDER BY id LIMIT 8")
def image_dedup(spark, sf_dir):
    return op.image_dedup(v.articles(spark, sf_dir)).select("id", "title")


@query(f"WITH {v.ARTICLES}, {_FREQ} SELECT id, word, n, rank FROM frequent")
def frequent_words(spark, sf_dir):
    return op.frequent_words(v.articles(spark, sf_dir))


@query(f"""WITH {v.ARTICLES.replace('articles AS', 'raw AS')}, articles AS (SELECT id, regexp_replace(title, '[^\\x00-\\x7f]', 'x', 'g') AS title, regexp_replace(abstract, '[^\\x00-\\x7f]', 'x', 'g') AS abstract FROM raw), {_FREQ}, t AS (SELECT id, regexp_replace(w, '[^a-zA-Z0-9\\-]', '', 'g') AS word FROM (SELECT id, unnest(regexp_split_to_array(title, '\\s+')) AS w FROM articles)),
h AS (SELECT id, unnest(list_filter(list_slice(regexp_extract_all(abstract, '\\b([a-zA-Z]+-[a-zA-Z]+(?:-[a-zA-Z]+)?)\\b', 1), 1, 8), lambda q: length(q) > 5)) AS word FROM articles),
c AS (SELECT id, unnest(regexp_extract_all(abstract, '\\b([A-Z][A-Z0-9]{{1,9}})\\b', 1)) AS word FROM articles)
SELECT DISTINCT id, word, 'title' AS kind FROM t WHERE length(word) > 3 AND NOT list_contains({_STOP}, lower(word)) UNION ALL SELECT DISTINCT id, word, 'acronym' FROM c UNION ALL SELECT DISTINCT id, word, 'hyphenated' FROM h UNION ALL SELECT id, word, 'frequent' FROM frequent""")
def keyword_extraction(spark, sf_dir):
    # ASCII letters only: the engines differ on what a word boundary is beside others
    a = v.articles(spark, sf_dir).withColumns({c: F.regexp_replace(c, r"[^\x00-\x7f]", "x") for c in ("title", "abstract")})
    return op.keywords(a)


@query(f"WITH {v.ARTICLES}, w AS (SELECT DISTINCT id, {_CLEAN} AS word FROM (SELECT id, unnest(regexp_split_to_array(abstract, '\\s+')) AS w FROM articles)) SELECT word, count(*) AS n FROM w WHERE length(word) > 4 AND NOT list_contains({_STOP}, word) GROUP BY word ORDER BY n DESC, word LIMIT 12")
def keyword_top12(spark, sf_dir):
    return op.corpus_words(v.articles(spark, sf_dir))


@query(f"WITH {v.ARTICLES} SELECT id, title, citations FROM (SELECT id, title, id * 7919 % 1000 AS citations FROM articles) ORDER BY citations DESC, id LIMIT 20")
def literature_sorted(spark, sf_dir):
    a = v.articles(spark, sf_dir).withColumns({"citations": F.col("id") * 7919 % 1000, "year": F.lit(None).cast("int")})
    return op.sort_articles(a, "citations", 20).select("id", "title", "citations")


@query(f"WITH {v.ARTICLES} SELECT source, count(*) AS n, count(*) FILTER (length(title) > 0) AS n_titled FROM articles GROUP BY source")
def source_counts(spark, sf_dir):
    return op.source_counts(v.articles(spark, sf_dir))


@query("SELECT coalesce(nullif(trim(role), ''), 'Unlabeled source') AS source, (conv_id * 1000 + turn) // 1024 AS block, list_sort(list(conv_id * 1000 + turn)) AS ids FROM conversations GROUP BY ALL")
def evidence_by_source(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("source"))
    return op.by_source(c)


_NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
#: Sentences put in front of conversation turns, so that every category comes up.
PROBES = ["Design a mevalonate pathway with FBA", "Which enzyme does yeast use?", "Summarise my current project", "What is the stock price today", "Tell me about Ada Lovelace", "Hello there", "  "]


def _probes(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") * 31 + F.col("turn")) % len(PROBES) + 1
    return c.select("conv_id", "turn", F.when(n == 7, "  ").otherwise(F.concat(F.element_at(F.array(*map(F.lit, PROBES)), n.cast("int")), F.lit(" "), F.lpad(F.col("turn").cast("string"), 3, "0"))).alias("q"))


@query(f"""WITH p AS (SELECT conv_id, turn, CASE (conv_id * 31 + turn) % 7 + 1 WHEN 7 THEN '  ' ELSE {_list(PROBES)}[(conv_id * 31 + turn) % 7 + 1] || ' ' || lpad(turn::VARCHAR, 3, '0') END AS q FROM conversations),
h AS (SELECT conv_id, turn, q, {', '.join(f"list_filter({_list(w)}, lambda x: contains({_NORM.format('q')}, x)) AS {n}" for n, w in (('path', k.PATHWAY_WORDS), ('near', k.ADJACENT_WORDS), ('bench', k.WORKBENCH_WORDS), ('off', k.OFF_DOMAIN_WORDS)))},
 trim(regexp_extract({_NORM.format('q')}, '\\b(who is|who''s|tell me about|what do you know about)\\s+([a-z][a-z .''-]{{2,60}})', 2)) AS subject FROM p),
c AS (SELECT *, CASE WHEN trim(q) = '' THEN 'ambiguous' WHEN len(off) > 0 AND len(path) = 0 THEN 'off-domain' WHEN subject <> '' AND len(path) = 0 AND len(near) = 0 THEN 'off-domain' WHEN len(path) > 0 THEN 'scientific-pathway' WHEN len(near) > 0 THEN 'scientific-adjacent' WHEN len(bench) > 0 THEN 'workbench-ops' ELSE 'ambiguous' END AS category FROM h)
SELECT conv_id, turn, category, CASE category WHEN 'scientific-pathway' THEN path WHEN 'scientific-adjacent' THEN near WHEN 'workbench-ops' THEN bench WHEN 'off-domain' THEN CASE WHEN len(off) > 0 THEN off ELSE ['who-is:' || substr(subject, 1, 40)] END ELSE [] END AS signals FROM c""")
def domain_classify(spark, sf_dir):
    return _probes(spark, sf_dir).select("conv_id", "turn", x.classify_domain(F.col("q")).alias("d")).select("conv_id", "turn", "d.category", "d.signals")


@query("""WITH e AS (SELECT event_id, props, CASE event_id % 7 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'sliced' WHEN 6 THEN 'repaired' END AS strategy FROM events)
SELECT event_id, strategy, strategy IS NOT NULL AS found, CASE WHEN strategy IS NOT NULL THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE event_id % 7 WHEN 3 THEN 'no-object' WHEN 4 THEN 'invalid-syntax' WHEN 5 THEN 'empty' END AS reason FROM e""")
def json_salvage(spark, sf_dir):
    n, p = F.col("event_id") % 7, F.col("props")
    broken = F.concat(F.lit("so: "), F.replace(F.replace(p, F.lit('"'), F.lit("'")), F.lit("}"), F.lit(", }")), F.lit("."))
    raw = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Answer: "), p, F.lit(" end"))).when(n == 3, "no object").when(n == 4, F.concat(F.lit("x {"), p, F.lit(" y"))).when(n == 5, " ").otherwise(broken)
    e = v.table(spark, sf_dir, "events").select("event_id", x.salvage_json(raw).alias("s"))
    return e.select("event_id", "s.strategy", F.col("s.json").isNotNull().alias("found"), F.get_json_object("s.json", "$.k").cast("long").alias("k"), "s.reason")


@query("SELECT page_id, substr(regexp_replace(lower(url), '[^a-z0-9_]', '_', 'g'), 1, 64) AS node, CASE WHEN length(url) <= 24 THEN url ELSE rtrim(substr(url, 1, 23)) || '…' END AS short, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def text_functions(spark, sf_dir):
    p = v.table(spark, sf_dir, "pages")
    return p.select("page_id", x.node_id(F.col("url")).alias("node"), x.truncated(F.col("url"), 24).alias("short"), x.escape_html(F.col("html")).alias("safe"))


@query(f"""WITH {v.ARTICLES}, t AS (SELECT id, regexp_split_to_array(trim(title), '\\s+') AS w FROM articles) SELECT id, array_to_string(w, ' ') AS text FROM t""")
def inverted_index_decode(spark, sf_dir):
    w = F.split(F.trim("title"), r"\s+")
    a = v.articles(spark, sf_dir).select("id", w.alias("w"))
    each = a.select("id", F.posexplode("w").alias("at", "term")).groupBy("id", "term").agg(F.collect_list("at").alias("at"))
    index = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"))
    return index.select("id", x.inverted_index_text(F.col("m")).alias("text"))


@query("SELECT n_nationkey AS place, chr(65 + n_nationkey % 8) || (n_nationkey // 8 + 1)::VARCHAR AS well, n_nationkey::BIGINT AS back FROM nation")
def well_names(spark, sf_dir):
    n = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"))
    return n.withColumn("well", x.well_name(F.col("place"))).withColumn("back", x.well_index(F.col("well")).cast("long"))


@query(f"WITH {v.DNA} SELECT id, length(seq) AS n, {r('coalesce((length(seq) - length(translate(seq, chr(71) || chr(67), ' + chr(39) * 2 + '))) / nullif(length(seq), 0)::DOUBLE, 0.0)', 'gc', 3)} FROM dna")
def gc_content(spark, sf_dir):
    return v.dna(spark, sf_dir).select("id", F.length("seq").cast("long").alias("n"), s.gc_content(F.col("seq")).alias("gc"))


@query(f"WITH {v.DNA} SELECT id, reverse(translate(seq, 'ATCG', 'TAGC')) AS rc FROM dna")
def reverse_complement(spark, sf_dir):
    return v.dna(spark, sf_dir).select("id", s.reverse_complement(F.col("seq")).alias("rc"))


_NN = "MAP {" + ", ".join(f"'{p}': [{a}.0, {b}]" for p, (a, b) in k.NEAREST_NEIGHBOUR.items()) + "}"


def _tm(seq: str) -> str:
    at = f"((CASE WHEN substr({seq}, 1, 1) IN ('A', 'T') THEN 1 ELSE 0 END) + (CASE WHEN right({seq}, 1) IN ('A', 'T') THEN 1 ELSE 0 END))"
    total = lambda i: f"list_sum(list_transform(range(1, length({seq})), lambda i: ({_NN})[substr({seq}, i, 2)][{i}]))"
    tm = f"({total(1)} + {at} * 2300.0) / ({total(2)} + {at} * 4.1 + 0.368 * ln(0.05) * (length({seq}) - 1) + 1.987 * ln(250e-9 / 4)) - 273.15"
    return f"CASE WHEN length({seq}) < 2 THEN 0.0 ELSE floor(({tm}) * 10 + 0.5) / 10 END"


@query(f"WITH {v.DNA}, p AS (SELECT id, seq AS p FROM dna) SELECT id, {_tm('p')} AS tm FROM p")
def melting_temp(spark, sf_dir):
    return v.dna(spark, sf_dir).select("id", s.melting_temp(F.col("seq")).alias("tm"))


@query(f"WITH {v.DNA}, p AS (SELECT id, seq AS p, reverse(translate(seq, 'ATCG', 'TAGC')) AS q, range(1, greatest(length(seq) - 4, 1)) AS pos FROM dna) SELECT id, list_has_any(list_transform(pos, lambda i: substr(p, i, 6)), list_transform(pos, lambda i: substr(q, i, 6))) AS dimer FROM p")
def self_dimers(spark, sf_dir):
    return v.dna(spark, sf_dir).select("id", s.self_complementary(F.col("seq")).alias("dimer"))


_FRAG = f"""WITH {v.DNA}, c AS (SELECT id, seq, greatest(2, ceil(length(seq) / 770.0))::INTEGER AS k FROM dna WHERE length(seq) > 0), z AS (SELECT *, ceil(length(seq) / k::DOUBLE)::INTEGER AS size FROM c),
f AS (SELECT id, seq, size, unnest(range(k))::INTEGER AS fragment FROM z), g AS (SELECT id, fragment, least(fragment * size, length(seq)) AS start, seq AS whole, size FROM f), h AS (SELECT id, fragment, start, substr(whole, start + 1, least(start + size + 30, length(whole)) - start) AS seq FROM g)"""


@query(f"{_FRAG} SELECT id, fragment, start::INTEGER AS start, length(seq) AS length, {r('coalesce((length(seq) - length(translate(seq, chr(71) || chr(67), ' + chr(39) * 2 + '))) / nullif(length(seq), 0)::DOUBLE, 0.0)', 'gc', 3)} FROM h")
def gibson_fragments(spark, sf_dir):
    return s.fragments(v.dna(spark, sf_dir)).drop("seq").withColumn("length", F.col("length").cast("long"))


@query(f"""{_FRAG}, b AS (SELECT id, fragment, n, substr(seq, 1, n) AS binding FROM h, range(18, 26) t(n) WHERE length(seq) >= 18), m AS (SELECT id, fragment, n, binding, {_tm('binding')} AS tm FROM b)
SELECT id, fragment, arg_min(binding, (abs(tm - 62.0), n)) AS binding, arg_min(tm, (abs(tm - 62.0), n)) AS tm FROM m GROUP BY ALL""")
def primer_design(spark, sf_dir):
    return s.primers(s.fragments(v.dna(spark, sf_dir)))
