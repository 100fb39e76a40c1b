import hashlib
import re

from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import chunking as K
from quillon.queries import extraction


def slow_sections(text):
    """(path, text) of each heading's lines, line by line."""
    open_, out, lines = [], [], []
    path = []
    for line in re.split(r"\r\n|\r|\n", text):
        m = re.match(r"(#{1,4})\s+(.+)", line)
        if m:
            out.append((path, "\n".join(lines).strip()))
            open_ = [x for x in open_ if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            path, lines = [t for _, t in open_], [m[2].strip()]
        else:
            lines.append(line)
    out.append((path, "\n".join(lines).strip()))
    return [x for x in out if x[1]]


def test_all_sections(spark, sf):
    """Every section, that of the document's text among them."""
    pages = extraction._files(spark, sf).select("doc_id", K.clean_markup(F.col("text")).alias("t")).collect()
    want = {(r.doc_id, i, " > ".join(p), hashlib.md5(t.encode()).hexdigest()) for r in pages for i, (p, t) in enumerate(slow_sections(r.t))}
    got = {(r.doc_id, r.section_pos, r.path, r.md5) for r in catalog.queries()["all_sections"](spark, sf).collect()}
    assert got == want
    assert {r.doc_id for r in pages} == {d for d, pos, _, _ in got if pos == 1}
