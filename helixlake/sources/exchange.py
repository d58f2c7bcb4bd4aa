"""Files that other programs read or write: genetic designs as RDF/XML, and folders of benchmark cases in which some files may be broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.functions.text import escape_html
from helixlake.session import stored

#: The namespaces of a design document, and the addresses of its terms.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "sbol": "http://sbols.org/v3#", "dcterms": "http://purl.org/dc/terms/", "prov": "http://www.w3.org/ns/prov#", "om": "http://www.ontology-of-units-of-measure.org/resource/om-2/",
    "SO": "http://identifiers.org/SO:", "SBO": "http://identifiers.org/biomodels.sbo/",
}
DNA, ROLE, INTERACTION, PRECEDES, CONSTRUCT = "http://www.biopax.org/release/biopax-level3.owl#DnaRegion", "http://identifiers.org/SO:", "http://identifiers.org/biomodels.sbo/SBO:", "http://sbols.org/v3#precedes", "http://identifiers.org/SO:0000804"
ROW = "sbol:Component"
_REF = "STRUCT<`_rdf:resource`: STRING>"
XML = f"""`_rdf:about` STRING, `sbol:displayId` STRING, `sbol:name` STRING, `dcterms:description` STRING, `sbol:type` {_REF}, `sbol:role` {_REF},
 `sbol:hasFeature` ARRAY<STRUCT<`sbol:SubComponent`: STRUCT<`_rdf:about`: STRING, `sbol:displayId`: STRING, `sbol:instanceOf`: {_REF}>>>,
 `sbol:hasConstraint` ARRAY<STRUCT<`sbol:Constraint`: STRUCT<`_rdf:about`: STRING, `sbol:restriction`: {_REF}, `sbol:subject`: {_REF}, `sbol:object`: {_REF}>>>,
 `sbol:hasInteraction` ARRAY<STRUCT<`sbol:Interaction`: STRUCT<`_rdf:about`: STRING, `sbol:displayId`: STRING, `sbol:type`: {_REF}, `sbol:hasParticipation`: ARRAY<STRUCT<`sbol:Participation`: STRUCT<`sbol:participant`: {_REF}>>>>>>"""


def _ref(c):
    return F.struct(c.alias("_rdf:resource"))


def sbol_rows(components: DataFrame, interactions: DataFrame, namespace: str) -> DataFrame:
    """(construct, parts) of each construct as they stand in RDF/XML: its own component, and the list of its parts' components.

    ``components`` (doc, place, id, name, role, description) are the parts in order, ``interactions`` (doc, id, type, participants) name
    parts. A construct's parts are its features, and each must precede the next; they are few.
    """
    ns, lit = F.lit(f"{namespace}/"), F.lit
    at = lambda *parts: F.concat(ns, *parts)
    parts = components.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "id", "name", "role", "description"))).alias("p"))
    acts = interactions.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "type", "participants"))).alias("a"))
    doc = F.col("doc").cast("string")
    sub = lambda i: at(doc, lit("/SubComponent_"), i)
    feature = lambda p: F.struct(F.struct(sub(p["id"]).alias("_rdf:about"), F.concat(lit("SubComponent_"), p["id"]).alias("sbol:displayId"), _ref(at(p["id"])).alias("sbol:instanceOf")).alias("sbol:SubComponent"))
    pairs = F.filter(F.transform("p", lambda p, i: F.struct(p["id"].alias("a"), F.get("p", i + 1)["id"].alias("b"), i.alias("i"))), lambda x: x["b"].isNotNull())
    constraint = lambda x: F.struct(F.struct(at(doc, lit("/Constraint_"), x["i"].cast("string")).alias("_rdf:about"), _ref(lit(PRECEDES)).alias("sbol:restriction"), _ref(sub(x["a"])).alias("sbol:subject"), _ref(sub(x["b"])).alias("sbol:object")).alias("sbol:Constraint"))
    person = lambda i: F.struct(F.struct(_ref(sub(i)).alias("sbol:participant")).alias("sbol:Participation"))
    act = lambda a: F.struct(F.struct(at(doc, lit("/"), a["id"]).alias("_rdf:about"), a["id"].alias("sbol:displayId"), _ref(F.concat(lit(INTERACTION), F.regexp_replace(a["type"], "^SBO:", ""))).alias("sbol:type"), F.transform(a["participants"], person).alias("sbol:hasParticipation")).alias("sbol:Interaction"))
    top = F.struct(at(doc).alias("_rdf:about"), doc.alias("sbol:displayId"), doc.alias("sbol:name"), F.concat(lit("construct of "), F.size("p").cast("string"), lit(" parts")).alias("dcterms:description"), _ref(lit(DNA)).alias("sbol:type"), _ref(lit(CONSTRUCT)).alias("sbol:role"), F.transform("p", feature).alias("sbol:hasFeature"), F.transform(pairs, constraint).alias("sbol:hasConstraint"), F.transform("a", act).alias("sbol:hasInteraction"))
    own = lambda p: F.struct(at(p["id"]).alias("_rdf:about"), p["id"].alias("sbol:displayId"), p["name"].alias("sbol:name"), F.coalesce(p["description"], lit("")).alias("dcterms:description"), _ref(lit(DNA)).alias("sbol:type"), _ref(F.concat(lit(ROLE), F.regexp_replace(p["role"], "^SO:", ""))).alias("sbol:role"))
    return parts.join(acts, "doc", "left").select(top.alias("construct"), F.transform("p", own).alias("parts"))


def element(tag: str, c: Column, kind: T.DataType) -> Column:
    """A value as an XML element, nothing for null: fields of a struct are elements, those that begin with _ attributes; a list is one element an item."""
    lit, none = F.lit, F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: element(tag, x, kind.elementType)), ""), none)
    if not isinstance(kind, T.StructType):
        return F.coalesce(F.concat(lit(f"<{tag}>"), escape_html(c.cast("string")), lit(f"</{tag}>")), none)
    attributes = [F.coalesce(F.concat(lit(f' {f.name[1:]}="'), escape_html(c[f.name].cast("string")), lit('"')), none) for f in kind if f.name.startswith("_")]
    inside = [element(f.name, c[f.name], f.dataType) for f in kind if not f.name.startswith("_")]
    return F.when(c.isNotNull(), F.concat(lit(f"<{tag}"), *attributes, lit(">"), *inside, lit(f"</{tag}>"))).otherwise(none)


def sbol_documents(rows: DataFrame) -> DataFrame:
    """(xml) of :func:`sbol_rows`: one whole RDF/XML document a construct. Spark's own XML writer takes no names with prefixes."""
    names = " ".join(f'xmlns:{prefix}="{address}"' for prefix, address in NAMESPACES.items())
    inside = [element(ROW, F.col(c), rows.schema[c].dataType) for c in ("construct", "parts")]
    return rows.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rdf:RDF {names}>'), *inside, F.lit("</rdf:RDF>")).alias("xml"))


def read_sbol(spark: SparkSession, path: str) -> DataFrame:
    """A row a component of documents that are written one a line; lines that are none are left out.

    A document is parsed once: columns and filters above an exploded list don't repeat what it is made of.
    """
    lines = spark.read.text(path).select(F.explode(F.array(F.from_xml("value", f"`{ROW}` ARRAY<STRUCT<{XML.replace('` ', '`: ')}>>"))).alias("x"))
    return lines.select(F.explode(F.col("x")[ROW]).alias("row")).where("row IS NOT NULL").select("row.*")


def sbol_parts(rows: DataFrame) -> DataFrame:
    """(doc, place, id, role, name, before) read back: a construct's parts in the order that its constraints say."""
    tail = lambda c: F.element_at(F.split(c, "/SubComponent_"), -1)
    rows = stored(rows.select(*[F.col(f"`sbol:{c}`") for c in ("displayId", "name", "role", "hasFeature", "hasConstraint")]))  # read three times
    tops = rows.where(F.col("`sbol:hasFeature`").isNotNull())
    features = tops.select(F.col("`sbol:displayId`").alias("doc"), F.posexplode(F.col("`sbol:hasFeature`")).alias("place", "f"))
    features = features.select("doc", "place", tail(F.col("f")["sbol:SubComponent"]["_rdf:about"]).alias("id"))
    order = tops.select(F.col("`sbol:displayId`").alias("doc"), F.explode(F.col("`sbol:hasConstraint`")).alias("c")).select("doc", tail(F.col("c")["sbol:Constraint"]["sbol:subject"]["_rdf:resource"]).alias("id"), tail(F.col("c")["sbol:Constraint"]["sbol:object"]["_rdf:resource"]).alias("before"))
    parts = rows.where(F.col("`sbol:hasFeature`").isNull()).select(F.col("`sbol:displayId`").alias("id"), F.col("`sbol:name`").alias("name"), F.concat(F.lit("SO:"), F.element_at(F.split(F.col("`sbol:role`")["_rdf:resource"], "SO:"), -1)).alias("role"))
    return features.join(order, ["doc", "id"], "left").join(parts, "id", "left").select("doc", "place", "id", "role", "name", "before")


def load_cases(spark: SparkSession, path: str, names: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """:func:`read_cases` of the JSON files in a folder and those below."""
    raw = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).text(path, wholetext=True)
    return read_cases(raw.select(F.col("_metadata.file_path").alias("file"), "value"))


def load_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """:func:`read_cases` of files that are kept many to a bundle, one a line: an object of its name, ``file``, and its text, ``value``.

    Small files by the hundred thousand cost a folder's listing, an opening and a renaming each; bundles are as large as their tasks.
    """
    return read_cases(spark.read.schema("file STRING, value STRING").json(path))


def read_cases(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cases (file, caseId, title, category, toolId) of files (file, value), and (file, error) of all that is wrong with files.

    A file that can't be parsed, whose root is no object or that has no list of cases is an error and no exception; a file's
    unknown names and a missing ``$schema`` are errors too, and its cases count all the same.
    """
    raw = files.select("file", F.explode(F.array(F.try_parse_json("value"))).alias("v"))  # parsed once
    kind = F.schema_of_variant("v")
    root = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.cases", "variant")).startswith("ARRAY"), F.lit(False))
    typed = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$['$schema']", "variant")) == "STRING", F.lit(False))
    other = F.filter(F.coalesce(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")), F.array().cast("array<string>")), lambda n: ~n.isin("$schema", "cases"))
    errors = F.concat(
        F.filter(F.array(F.when(F.col("v").isNull(), "invalid JSON").when(~root, "root must be an object"), F.when(root & ~typed, "$schema must be a string"), F.when(root & ~listed, "cases must be an array")), lambda x: x.isNotNull()),
        F.transform(F.when(root, other).otherwise(F.array().cast("array<string>")), lambda n: F.concat(F.lit("unknown name "), n)),
    )
    own = raw.select("file", F.when(root & listed, F.try_variant_get("v", "$.cases", "array<variant>")).alias("cases"), errors.alias("errors"))
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get("c", f"$.{n}", "variant")) == "STRING", F.try_variant_get("c", f"$.{n}", "string")).alias(n)
    cases = own.select("file", F.explode("cases").alias("c")).select("file", *[field(n) for n in ("caseId", "title", "category", "toolId")])
    return cases, own.select("file", F.explode("errors").alias("error"))
