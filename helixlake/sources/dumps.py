"""Dumps of literature and image services as Spark data sources: ``spark.read.format("pubmed").load(folder)``.

A dump is a folder of JSON lines, a record of the service each. Files are read in ranges of bytes, one task a range, and a
filter of a column by equal or listed values is applied before a row is made. A line that is no record gives a row with ``error``
and nothing else, so nothing is lost silently. Folders are opened with pyarrow's file systems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Bytes of a file that one task reads.
RANGE = 64 << 20
AUTHORS = 3
ARTICLE = "id string, title string, abstract string, authors array<string>, journal string, year string, doi string, url string, source string, citations bigint, open_access boolean, preprint boolean, error string"
IMAGE = "id string, title string, description string, thumbnail string, url string, source string, organism string, method string, error string"
DESCRIPTION = 150


def dig(value, *path):
    """The part of a record at a path of names and places; None where there is none."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and len(value) > step else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def words(index) -> str:
    """A text out of the places of its words."""
    placed = [(p, w) for w, places in index.items() for p in places] if isinstance(index, dict) else []
    return " ".join(w for _, w in sorted(placed))


def _text(value) -> str:
    return "" if value is None else str(value)


def _names(people, *path) -> list[str]:
    return [_text(dig(p, *path)) for p in (people if isinstance(people, list) else [])[:AUTHORS]]


def _article(x: dict, prefix: str, key, **own) -> dict:
    return {"id": f"{prefix}-{_text(key)}", "title": _text(x.get("title")), "citations": None, "open_access": None, "preprint": None} | own


def pubmed(x: dict) -> dict:
    doi = next((_text(dig(i, "value")) for i in x.get("articleids") or [] if dig(i, "idtype") == "doi"), "")
    return _article(x, "pm", x.get("uid"), abstract=_text(x.get("abstract")), authors=_names(x.get("authors"), "name"), journal=_text(x.get("source")), year=_text(x.get("pubdate")).split(" ")[0], doi=doi, url=f"https://pubmed.ncbi.nlm.nih.gov/{_text(x.get('uid'))}/")


def europe_pmc(x: dict) -> dict:
    doi = _text(x.get("doi"))
    people = x["authorString"].split(",")[:AUTHORS] if x.get("authorString") else []
    url = f"https://doi.org/{doi}" if doi else f"https://europepmc.org/article/{_text(x.get('source'))}/{_text(x.get('id'))}"
    return _article(x, "epmc", x.get("id"), abstract=_text(x.get("abstractText")), authors=people, journal=_text(x.get("journalTitle")), year=_text(x.get("pubYear")), doi=doi, url=url, citations=x.get("citedByCount"), open_access=x.get("isOpenAccess") == "Y")


def semantic_scholar(x: dict) -> dict:
    doi = _text(dig(x, "externalIds", "DOI"))
    return _article(x, "ss", x.get("paperId"), abstract=_text(x.get("abstract")), authors=_names(x.get("authors"), "name"), journal=_text(x.get("venue") or dig(x, "journal", "name")), year=_text(x.get("year")), doi=doi, url=f"https://doi.org/{doi}" if doi else f"https://www.semanticscholar.org/paper/{_text(x.get('paperId'))}", citations=x.get("citationCount"), open_access=x.get("isOpenAccess"))


def open_alex(x: dict) -> dict:
    where = x.get("primary_location")
    return _article(x, "oa", x.get("id"), abstract=words(x.get("abstract_inverted_index")), authors=_names(x.get("authorships"), "author", "display_name"), journal=_text(dig(where, "source", "display_name")), year=_text(x.get("publication_year")), doi=_text(x.get("doi")).replace("https://doi.org/", "", 1), url=_text(dig(where, "landing_page_url") or x.get("doi") or x.get("id")), citations=x.get("cited_by_count"), open_access=dig(x, "open_access", "is_oa"))


def biorxiv(x: dict) -> dict:
    own = europe_pmc(x)
    return own | {"id": f"biorxiv-{_text(x.get('id'))}", "journal": "bioRxiv", "url": f"https://doi.org/{own['doi']}" if own["doi"] else "", "citations": None, "preprint": True, "open_access": True}


def core(x: dict) -> dict:
    return _article(x, "core", x.get("id"), abstract=_text(x.get("abstract")), authors=_names(x.get("authors"), "name"), journal=_text(dig(x, "journals", 0, "title")), year=_text(x.get("yearPublished")), doi=_text(x.get("doi")), url=_text(x.get("downloadUrl")), open_access=True)


def commons(x: dict) -> dict | None:
    """None for a page without a picture."""
    import re
    from urllib.parse import quote

    if not dig(x, "thumbnail", "source"):
        return None
    title, snippet = _text(x.get("title")), re.sub("<[^>]*>", "", _text(x.get("snippet")))
    return {"id": f"wiki-{_text(x.get('pageid'))}", "title": title, "description": snippet[:DESCRIPTION] or title, "thumbnail": x["thumbnail"]["source"], "url": f"https://en.wikipedia.org/wiki/{quote(title, safe='')}", "organism": None, "method": None}


def cell_image_library(x: dict) -> dict:
    own = dig(x, "CIL_CCDB", "CIL")
    key, organism = _text(dig(own, "Image", "Image_ID")), dig(own, "Biological_Context", "Organism", 0)
    return {"id": f"cil-{key}", "title": _text(organism), "description": _text(dig(own, "Image", "Description"))[:DESCRIPTION], "thumbnail": f"https://cellimagelibrary.org/images/{key}/thumbnail", "url": f"https://cellimagelibrary.org/images/{key}", "organism": organism, "method": dig(own, "Image", "Image_Type", 0)}


def image_data_resource(x: dict) -> dict:
    key, name = _text(x.get("@id")), _text(x.get("Name"))
    return {"id": f"idr-{key}", "title": name, "description": f"IDR image dataset — {name}", "thumbnail": f"https://idr.openmicroscopy.org/webclient/render_thumbnail/{key}/", "url": f"https://idr.openmicroscopy.org/webclient/?show=image-{key}", "organism": None, "method": "Fluorescence" if x.get("AcquisitionDate") else "Microscopy"}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _open(uri: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class DumpReader(DataSourceReader):
    def __init__(self, label: str, make: Callable[[dict], dict | None], columns: list[str], path: str, size: int) -> None:
        self.label, self.make, self.columns, self.path, self.size = label, make, columns, path, size
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equal and listed values of one column are applied here; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None or name == "authors":
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self):
        from pyarrow import fs

        files, root = _open(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and not info.base_name.startswith((".", "_")):
                out += [Range(info.path, at, min(at + self.size, info.size)) for at in range(0, info.size, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = _open(self.path)
        with io.BufferedReader(files.open_input_file(partition.path)) as f:
            for line in lines(f, partition.start, partition.end):
                row = self._row(line)
                if row and all(row[name] in values for name, values in self.wanted.items()):
                    yield tuple(row[c] for c in self.columns)

    def _row(self, line: bytes) -> dict | None:
        none = dict.fromkeys(self.columns) | {"source": self.label}
        try:
            record = json.loads(line)
            own = self.make(record) if isinstance(record, dict) else {"error": "no record"}
        except (ValueError, TypeError, AttributeError) as e:
            own = {"error": type(e).__name__}
        return none | own if own is not None else None


def lines(f: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes."""
    f.seek(max(0, start - 1))
    if start:
        f.readline()  # up to the first line that begins here
    while f.tell() < end and (line := f.readline()):
        if line.strip():
            yield line


class Source(NamedTuple):
    label: str
    make: Callable[[dict], dict | None]
    schema: str


SOURCES = {
    "pubmed": Source("PubMed", pubmed, ARTICLE), "europepmc": Source("Europe PMC", europe_pmc, ARTICLE), "semanticscholar": Source("Semantic Scholar", semantic_scholar, ARTICLE),
    "openalex": Source("OpenAlex", open_alex, ARTICLE), "biorxiv": Source("bioRxiv", biorxiv, ARTICLE), "core": Source("CORE", core, ARTICLE),
    "wikipedia": Source("Wikipedia", commons, IMAGE), "cil": Source("Cell Image Library", cell_image_library, IMAGE), "idr": Source("EMBL-EBI IDR", image_data_resource, IMAGE),
}


def data_source(key: str, own: Source) -> type[DataSource]:
    class Dump(DataSource):
        @classmethod
        def name(cls) -> str:
            return key

        def schema(self) -> str:
            return own.schema

        def reader(self, schema) -> DumpReader:
            return DumpReader(own.label, own.make, schema.names, self.options["path"], int(self.options.get("range", RANGE)))

    return Dump


class Registry:
    """Sources by name: which there are, and reading from them; a name without a source gives an error row and no exception."""

    def __init__(self, spark: SparkSession, sources: dict[str, Source] = SOURCES) -> None:
        self.spark, self.sources = spark, dict(sources)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for key, own in self.sources.items():
            spark.dataSource.register(data_source(key, own))

    def names(self) -> list[str]:
        return list(self.sources)

    def available(self, name: str) -> bool:
        return name in self.sources

    def read(self, name: str, path: str, **options) -> DataFrame:
        if self.available(name):
            return self.spark.read.format(name).options(**options).load(path)
        told = {"source": name, "error": f'Source "{name}" has no reader.'}
        fields = self.spark.createDataFrame([], ARTICLE).schema
        return self.spark.range(1).select(*[F.lit(told.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])

    def union(self, paths: dict[str, str]) -> DataFrame:
        """The rows of several sources of one schema, error rows for names without a source."""
        out = None
        for name, path in paths.items():
            own = self.read(name, path)
            out = own if out is None else out.unionByName(own)
        return out
