import os

import duckdb
import pytest
from compare import same
from pyspark.sql import functions as F

from contactspark.llm import licenses, queries

KNOWN = dict(licenses.KNOWN)
MIT, ISC, BSD2, BSD3 = (KNOWN[k] for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"))
CASES = [
    (1, MIT, "MIT"),
    (2, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT, "MIT"),
    (3, "Copyright (c) 2020 A. Person\n\n" + MIT.upper(), "MIT"),
    (4, MIT.replace("\n", " \n * ").replace("copyright holders", "COPYRIGHT-HOLDERS"), "MIT"),
    (5, MIT + " extra", None),
    (6, None, None),
    (7, "  ...\n", None),
    (8, ISC.replace("MERCHANTABILITY", "merchantibility"), "ISC"),
    (8, ISC, "ISC"),
    (None, MIT, "MIT"),
    (9, "(c) 1999-2001 someone\n" + BSD2.replace("1. ", "- ").replace("2. ", "(b) "), "BSD-2-Clause"),
    (10, "The MIT License (MIT)\n\nCopyright (c) Facebook, Inc. and its affiliates.\n\n" + MIT, "MIT"),
    (11, "Copyright Jane Doe\nAll rights reserved.\n\n" + BSD3, "BSD-3-Clause"),
    (12, "BSD 3-Clause License\n\nCopyright © 2015, Some Lab\nAll Rights Reserved\n" + BSD3, "BSD-3-Clause"),
    (13, "# Copyright [yyyy] [name of copyright owner]\n#\n# " + KNOWN["Apache-2.0-notice"].replace("http://", "https://").replace("\n", "\n# "), "Apache-2.0-notice"),
    (14, "Copyright notice and text of our own\n" + MIT, None),
    (15, "SPDX-Licence-Identifier: MIT", "SPDX-MIT-line"),
    (16, "word " * 30_000 + MIT, None),
]


def table(spark):
    return spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string").selectExpr("*", "'x' AS license_id", "'y' AS digest")


def test_variants_of_one_text(spark):
    docs, known = table(spark), licenses.known_digests(spark)
    out = sorted(((r.doc_id, r.license_id) for r in licenses.scan(docs, known).collect()), key=str)
    assert out == sorted([(d, i) for d, _, i in CASES], key=str)
    assert licenses.scan(docs.limit(0), known).count() == 0
    known = licenses.known_digests(spark, [("b", "Some text."), ("a", "some  TEXT"), ("c", None)])
    assert [r.license_id for r in known.collect()] == ["a"]


def test_spellings_that_follow_each_other(spark):
    row = spark.sql("SELECT 'licence licence behaviour behaviour, behaviour copyright owner copyright owner. sub licence' AS t").select(licenses.canonical(F.col("t")).alias("c")).first()
    assert row.c == "license license behavior behavior behavior copyright holder copyright holder sublicense"


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files")
def test_files_of_long_licenses(spark):
    rows = []
    for name, file in [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0")]:
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            text = open(path, encoding="utf-8").read()
            rows += [(name, text), (name, text.replace("\n", "\r\n")), (name, " * " + text.replace("\n", "\n * "))]
    out = licenses.known_digests(spark).alias("k").join(spark.createDataFrame(rows, "name string, text string").select("name", licenses.digest(F.col("text")).alias("digest")), "digest", "right")
    assert rows and all(r.license_id == r["name"] for r in out.collect())


def test_query_with_hits_is_its_sql(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = queries.QUERIES["op3_license_scan"](spark, str(tmp_path))
    assert out.where("license_id IS NOT NULL").count() == sum(c[2] is not None for c in CASES)
    same(out, con.sql(queries.ORACLE_SQL["op3_license_scan"]))
