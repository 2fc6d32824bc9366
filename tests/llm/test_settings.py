"""Results that no setting of Arrow changes, and whole license texts against their relatives."""

import re

import pytest

from gridloom.llm import queries as Q
from gridloom.llm.licenses import TEXTS, license_scan
from gridloom.llm.packing import pack_documents
from gridloom.llm.repair import encode_to_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("work", [pack_documents, encode_to_files])
def test_batches_do_not_decide_where_shards_end(spark, work):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id")
    found = []
    for rows in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = work(docs, Q.TOKENIZER, end_id=1)
            found.append(sorted(tuple(str(x) for x in r) for r in got.collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) >= 200


def _text(name):
    return max((t for n, t in TEXTS if n == name), key=len)


def _wrapped(text):
    return "Some project\n\n" + re.sub(r"(.{60,80}) ", "\\1\n", text) + "\n\nEnd of the file."


GPL, CC = _text("GPL-3.0"), _text("CC-BY-SA-4.0")
AGPL = GPL.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("13. Use with the GNU Affero General Public License.", "13. Remote Network Interaction; Use with the GNU General Public License.")
OWN_CLAUSE = re.search(r"(?s)b\. ShareAlike\..*?(?=Section 4)", CC)
CASES = {
    "GPL-3.0": GPL, "AGPL-3.0": AGPL, "CC-BY-SA-4.0": CC, "CC-BY-4.0": CC.replace(OWN_CLAUSE[0], "").replace("-ShareAlike", ""),
    "CC-BY-NC-SA-4.0": CC.replace("Attribution-ShareAlike", "Attribution-NonCommercial-ShareAlike"), "LGPL-3.0": _text("LGPL-3.0"), "GFDL-1.3": _text("GFDL-1.3"), "GFDL-1.2": _text("GFDL-1.2"),
    "EPL-1.0": _text("EPL-1.0"), "EPL-2.0": _text("EPL-1.0").replace("2. GRANT OF RIGHTS", '"Secondary License" means a later version of it; code is distributed under Secondary Licenses. 2. GRANT OF RIGHTS'), "Apache-2.0": _text("Apache-2.0"),
}


def test_whole_texts_are_told_from_their_relatives(spark):
    assert OWN_CLAUSE
    docs = spark.createDataFrame([(n, _wrapped(t)) for n, t in CASES.items()], "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert CASES["EPL-2.0"] != CASES["EPL-1.0"] and got == {n: [n] for n in CASES}
