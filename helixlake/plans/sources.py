"""Queries of dump sources and tool adapters."""

import uuid

from pyspark.sql import functions as F

from helixlake.operators import adapters as op
from helixlake.operators import flux, state
from helixlake.plans.registry import query
from helixlake.session import shared_dir
from helixlake.sources import dumps
from helixlake.sources import views as v

_ARTICLES, _IMAGES = ("pubmed", "europepmc", "semanticscholar", "openalex", "biorxiv", "core"), ("wikipedia", "cil", "idr")


def write_dumps(spark, sf_dir) -> dict[str, str]:
    """A dump of each service with a share of the documents, in the form the service has; a few lines of each are no records."""
    root = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    n, s, a = F.col("doc_id"), F.struct, F.array
    key, lit = n.cast("string"), F.lit
    people = F.transform(F.sequence(lit(1), (n % 5).cast("int") + 1), lambda i: s(F.concat(lit("Author "), i.cast("string")).alias("name")))
    doi = F.when(n % 3 != 0, F.concat(lit("10.1/"), key))
    year = (1990 + n % 30).cast("string")
    epmc = s(key.alias("id"), F.col("lang").alias("title"), F.col("text").alias("abstractText"), F.when(n % 4 != 0, lit("A B,C D,E F,G H")).alias("authorString"), F.col("source").alias("journalTitle"), year.alias("pubYear"), doi.alias("doi"), lit("MED").alias("source"), F.col("n_chars").alias("citedByCount"), F.when(n % 2 == 0, "Y").otherwise("N").alias("isOpenAccess"))
    bodies = {
        "pubmed": s(key.alias("uid"), F.col("lang").alias("title"), F.col("text").alias("abstract"), people.alias("authors"), F.col("source"), F.concat(year, lit(" Mar")).alias("pubdate"), a(s(lit("pii").alias("idtype"), lit("x").alias("value")), s(lit("doi").alias("idtype"), doi.alias("value"))).alias("articleids")),
        "europepmc": epmc, "biorxiv": epmc,
        "semanticscholar": s(key.alias("paperId"), F.col("lang").alias("title"), F.col("text").alias("abstract"), people.alias("authors"), F.when(n % 2 == 0, F.col("source")).alias("venue"), s(lit("J").alias("name")).alias("journal"), year.cast("int").alias("year"), s(doi.alias("DOI")).alias("externalIds"), F.col("n_chars").alias("citationCount"), (n % 2 == 0).alias("isOpenAccess")),
        "openalex": s(key.alias("id"), F.col("lang").alias("title"), F.create_map(lit("b"), a(lit(1), lit(3)), lit("a"), a(lit(0)), key, a(lit(2))).alias("abstract_inverted_index"), F.transform(people, lambda p: s(s(p["name"].alias("display_name")).alias("author"))).alias("authorships"), s(s(F.col("source").alias("display_name")).alias("source"), F.when(n % 2 == 0, F.concat(lit("https://x/"), key)).alias("landing_page_url")).alias("primary_location"), year.cast("int").alias("publication_year"), F.concat(lit("https://doi.org/"), doi).alias("doi"), F.col("n_chars").alias("cited_by_count"), s((n % 2 == 0).alias("is_oa")).alias("open_access")),
        "core": s(key.alias("id"), F.col("lang").alias("title"), F.col("text").alias("abstract"), people.alias("authors"), F.when(n % 2 == 0, a(s(F.col("source").alias("title")))).alias("journals"), year.cast("int").alias("yearPublished"), doi.alias("doi"), F.concat(lit("https://c/"), key).alias("downloadUrl")),
        "wikipedia": s(n.alias("pageid"), F.concat(lit("A/b "), key).alias("title"), F.concat(lit("<b>cell</b> "), key).alias("snippet"), F.when(n % 4 != 0, s(F.concat(lit("https://t/"), key).alias("source"))).alias("thumbnail")),
        "cil": s(s(s(s(key.alias("Image_ID"), F.repeat(lit("d"), 200).alias("Description"), a(lit("fluorescence")).alias("Image_Type")).alias("Image"), s(a(F.col("lang"), lit("x")).alias("Organism")).alias("Biological_Context")).alias("CIL")).alias("CIL_CCDB")),
        "idr": s(n.alias("@id"), F.col("lang").alias("Name"), F.when(n % 2 == 0, lit("2020")).alias("AcquisitionDate")),
    }
    docs = v.table(spark, sf_dir, "documents")
    for i, (name, body) in enumerate(bodies.items()):
        own = docs.where(n % len(bodies) == i)
        own.select(F.when(n % 50 == 7, "{broken").when(n % 50 == 8, "[1]").otherwise(F.to_json(body)).alias("value")).write.text(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in bodies}


_ORDER = ["pubmed", "europepmc", "biorxiv", "semanticscholar", "openalex", "core", "wikipedia", "cil", "idr"]
_D = "WITH d AS (SELECT doc_id AS n, text, lang, source AS s, n_chars, CASE WHEN doc_id % 3 <> 0 THEN '10.1/' || doc_id END AS doi, (1990 + doc_id % 30)::VARCHAR AS year, list_transform(range(1, least(3, doc_id % 5 + 1) + 1), lambda i: 'Author ' || i) AS people, doc_id % 50 IN (7, 8) AS bad FROM documents)"
_EPMC = "CASE WHEN n % 4 <> 0 THEN ['A B', 'C D', 'E F'] ELSE [] END"
_ROWS = {
    "pubmed": "'pm-' || n AS id, lang AS title, text AS abstract, people AS authors, s AS journal, year, coalesce(doi, '') AS doi, 'https://pubmed.ncbi.nlm.nih.gov/' || n || '/' AS url, 'PubMed' AS source, NULL::BIGINT AS citations, NULL::BOOLEAN AS open_access, NULL::BOOLEAN AS preprint, NULL::VARCHAR AS error",
    "europepmc": f"'epmc-' || n, lang, text, {_EPMC}, s, year, coalesce(doi, ''), coalesce('https://doi.org/' || doi, 'https://europepmc.org/article/MED/' || n), 'Europe PMC', n_chars, n % 2 = 0, NULL, NULL",
    "biorxiv": f"'biorxiv-' || n, lang, text, {_EPMC}, 'bioRxiv', year, coalesce(doi, ''), coalesce('https://doi.org/' || doi, ''), 'bioRxiv', NULL, true, true, NULL",
    "semanticscholar": "'ss-' || n, lang, text, people, CASE WHEN n % 2 = 0 THEN s ELSE 'J' END, year, coalesce(doi, ''), coalesce('https://doi.org/' || doi, 'https://www.semanticscholar.org/paper/' || n), 'Semantic Scholar', n_chars, n % 2 = 0, NULL, NULL",
    "openalex": "'oa-' || n, lang, 'a b ' || n || ' b', people, s, year, coalesce(doi, ''), CASE WHEN n % 2 = 0 THEN 'https://x/' || n ELSE coalesce('https://doi.org/' || doi, n::VARCHAR) END, 'OpenAlex', n_chars, n % 2 = 0, NULL, NULL",
    "core": "'core-' || n, lang, text, people, CASE WHEN n % 2 = 0 THEN s ELSE '' END, year, coalesce(doi, ''), 'https://c/' || n, 'CORE', NULL, true, NULL, NULL",
}


def _rows(names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {fields} FROM d WHERE n % 9 = {_ORDER.index(name)} AND NOT bad" for name, fields in names.items())


def _bad(labels: dict[str, str], columns: tuple[int, int]) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(['NULL'] * columns[0] + [chr(39) + label + chr(39)] + ['NULL'] * columns[1])}, CASE WHEN n % 50 = 7 THEN 'JSONDecodeError' ELSE 'no record' END FROM d WHERE n % 9 = {_ORDER.index(name)} AND bad" for name, label in labels.items())


_LABELS = {name: dumps.SOURCES[name].label for name in _ORDER}


@query(f"{_D} {_rows(_ROWS)} UNION ALL {_bad({n: _LABELS[n] for n in _ARTICLES}, (8, 3))} UNION ALL SELECT {', '.join(['NULL'] * 8)}, 'arxiv', NULL, NULL, NULL, 'Source \"arxiv\" has no reader.'")
def dump_articles(spark, sf_dir):
    paths = write_dumps(spark, sf_dir)
    return dumps.Registry(spark).union({n: paths[n] for n in _ARTICLES} | {"arxiv": ""})


_PICTURES = {
    "wikipedia": "'wiki-' || n AS id, 'A/b ' || n AS title, 'cell ' || n AS description, 'https://t/' || n AS thumbnail, 'https://en.wikipedia.org/wiki/A%2Fb%20' || n AS url, 'Wikipedia' AS source, NULL::VARCHAR AS organism, NULL::VARCHAR AS method, NULL::VARCHAR AS error",
    "cil": "'cil-' || n, lang, repeat('d', 150), 'https://cellimagelibrary.org/images/' || n || '/thumbnail', 'https://cellimagelibrary.org/images/' || n, 'Cell Image Library', lang, 'fluorescence', NULL",
    "idr": "'idr-' || n, lang, 'IDR image dataset — ' || lang, 'https://idr.openmicroscopy.org/webclient/render_thumbnail/' || n || '/', 'https://idr.openmicroscopy.org/webclient/?show=image-' || n, 'EMBL-EBI IDR', NULL, CASE WHEN n % 2 = 0 THEN 'Fluorescence' ELSE 'Microscopy' END, NULL",
}


@query(f"{_D} SELECT * FROM ({_rows(_PICTURES)}) WHERE NOT (source = 'Wikipedia' AND title[5:]::BIGINT % 4 = 0) UNION ALL {_bad({n: _LABELS[n] for n in _IMAGES}, (5, 2))}")
def dump_images(spark, sf_dir):
    paths = write_dumps(spark, sf_dir)
    return dumps.Registry(spark).union({n: paths[n] for n in _IMAGES})


def _reports(spark):
    """The two adapters there are: nodes of a pathway text, and flux balance of a request."""

    def pathway(tasks):
        nodes = F.size(F.filter(F.split(F.get_json_object("input", "$.path"), ">"), lambda x: F.trim(x) != ""))
        return tasks.select("task", F.when(nodes > 0, F.concat(F.lit('{"nodeCount":'), nodes.cast("string"), F.lit("}"))).alias("result"))

    def balance(tasks):
        own = tasks.select(F.col("task").alias("scenario"), state.coerce_request(F.col("input")).alias("r")).select("scenario", "r.glucose", "r.oxygen")
        return flux.closed_form(own).select(F.col("scenario").alias("task"), F.to_json(F.struct(F.col("biomass").alias("objectiveValue"), "feasible")).alias("result"))

    return op.Adapters([op.Registration("pathd", op.with_provenance(pathway, "pathd"), "Pathway design", "path"), op.Registration("fbasim", balance, "Flux balance", "glucose, oxygen")])


@query("""WITH t AS (SELECT o_orderkey AS task, ['pathd', 'fbasim', 'catdes', NULL][o_orderkey % 4 + 1] AS tool, o_orderkey AS n FROM orders), x AS (SELECT *, '{"path":"' || CASE WHEN n % 8 = 0 THEN '' ELSE repeat('x > ', (n % 5)::INTEGER) || 'y' END || '"}' AS input, '{"nodeCount":' || n % 5 + 1 || '}' AS payload, least((n % 20) * 2.0, n % 30, 25.0) AS pdh FROM t)
SELECT task, tool, CASE WHEN tool = 'fbasim' OR tool = 'pathd' AND n % 8 <> 0 THEN 'done' ELSE 'error' END AS status, CASE WHEN tool = 'fbasim' THEN NULL WHEN tool = 'pathd' AND n % 8 <> 0 THEN '{"payload":' || payload || ',"provenance":{"tool":"pathd","version":"1","input":"' || sha256(input) || '","payload":"' || sha256(payload) || '"}}' END AS report,
 CASE WHEN tool = 'fbasim' THEN floor(pdh * 10000 + 0.5) / 10000 END AS objective, CASE WHEN tool = 'pathd' AND n % 8 = 0 THEN 'no result' WHEN tool = 'catdes' OR tool IS NULL THEN 'Tool "' || coalesce(tool, '') || '" has no adapter.' END AS error FROM x""")
def adapter_runs(spark, sf_dir):
    n = F.col("o_orderkey")
    path = F.when(n % 8 == 0, "").otherwise(F.concat(F.repeat(F.lit("x > "), (n % 5).cast("int")), F.lit("y")))
    raw = F.when(n % 4 == 1, F.concat(F.lit('{"glucose": '), (n % 20).cast("string"), F.lit(', "oxygen": '), (n % 30).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"path":"'), path, F.lit('"}')))
    tasks = v.table(spark, sf_dir, "orders").select(n.alias("task"), F.get(F.array(F.lit("pathd"), F.lit("fbasim"), F.lit("catdes"), F.lit(None)), (n % 4).cast("int")).alias("tool"), raw.alias("input"))
    out = _reports(spark).run(tasks)
    balance = F.col("tool") == "fbasim"
    return out.select("task", "tool", "status", F.when(~F.coalesce(balance, F.lit(False)), F.col("result")).alias("report"), F.when(balance, F.get_json_object("result", "$.objectiveValue").cast("double")).alias("objective"), "error")
