from pathlib import Path

import pytest

from helixlake.llm import license_texts, licenses
from helixlake.llm.queries import ORACLE, op6_license_scan
from tests.llm.oracle import same

TEXTS = dict(license_texts._TEXTS)
SHARED = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


def table(spark):
    mit, bsd = TEXTS["MIT"], TEXTS["BSD-3-Clause"]
    texts = [
        mit, "My terms\n" + mit, "Copyright (c) 2001 Some One\n© 2002\nAll rights reserved.\n\n" + mit.upper().replace(",", " ,\n"),
        bsd.replace("1. ", "* ").replace("2. ", "  (b) ").replace('"AS IS"', "“as is”"), bsd.replace("permission", "permissions"),
        TEXTS["BSL-1.0"].replace("organization", "organisation").replace("license", "licence"),
        "Some words.\n  released under the mit licence\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", None, "", "...\n--", "x " * 50_000, "Copyright (c) 1999 Only",
    ]
    return spark.createDataFrame([(i, t, "clash", "d") for i, t in enumerate(texts)], "doc_id long, text string, license string, digest string")


def test_canonical_texts(spark):
    got = {r.doc_id: r for r in licenses.scan(table(spark)).collect()}
    assert [got[i].license for i in range(12)] == ["MIT", None, "MIT", "BSD-3-Clause", None, "BSL-1.0", None, None, None, None, None, None]
    assert (got[6].n_notices, got[6].notices) == (3, "CC-BY-NC-4.0,MIT")
    assert sorted(i for i in got if got[i].digest is None) == [7, 8, 9, 11] and sum(r.n_notices for r in got.values()) == 3


def test_sql_agrees(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    same(op6_license_scan(spark, str(tmp_path)), ORACLE["op6_license_scan"], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


def test_edge_tables(spark):
    assert licenses.scan(table(spark).limit(0)).count() == 0
    rows = [(None, "Released under the MIT License."), (1, "a"), (1, "Released under the MIT License."), (1, "Released under the MIT License.")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license or "", r.n_notices) for r in out) == [(0, "MIT", 1), (1, "", 0), (1, "MIT", 1), (1, "MIT", 1)]
    own = spark.createDataFrame([("Mine", "My own terms!"), ("Yours", "MY OWN terms"), (None, "x"), ("Empty", None)], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "my own: terms")], "doc_id long, text string"), own).first().license == "Mine"


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_titled_texts_and_altered_ones(spark, name):
    texts = [f"{title}\n\nCopyright (c) 2020 Some One\n\n{TEXTS[name]}" for title in license_texts.TITLES[name]]
    altered = TEXTS[name].replace(" or ", " nor ", 1)
    assert altered != TEXTS[name]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(enumerate([*texts, altered])), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [name] * len(texts) and got[len(texts)] is None


@pytest.mark.skipif(not SHARED.is_dir(), reason="no licence files here")
def test_whole_texts_as_distributed(spark):
    texts = {name: (SHARED / file).read_text() for name, file in FILES.items()}
    rows = [*texts.items(), *((f"{name}, altered", t.replace(" the ", " thus ", 1)) for name, t in texts.items())]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: name for name in texts} | {f"{name}, altered": None for name in texts}
