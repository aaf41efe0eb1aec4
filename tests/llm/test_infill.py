"""Fill-in-the-middle against cutting with a regular expression, and the round trip."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docket_spark.llm import infill
from tests.llm.tables import documents, hard_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.lists(st.sampled_from([" ", "\n", "\t\t", "a", "wört", "日本", "🙂", " ", "x" * 30])).map("".join)


def plain_cuts(text, first, second):
    units = UNIT.findall(text)
    low, high = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    return len(units), len("".join(units[:low])), len("".join(units[:high]))


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 7, 1024]))
def test_cuts_equal_those_of_the_expression(text, first, second, block):
    assert infill.cuts(text.encode(), first, second, block) == plain_cuts(text, first, second)


def test_every_cut_of_a_text_over_many_blocks():
    text = " ".join(f"wörd{k}  🙂\n" for k in range(200)) + " \n "
    n = len(UNIT.findall(text))
    for k in range(n + 1):
        assert infill.cuts(text.encode(), k, n, 64) == plain_cuts(text, k, n)


def test_fenwick_sums():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 64, 77):
        counts = draw.integers(0, 4, (n, 2))
        tree = infill.Fenwick(counts)
        assert tree.total.tolist() == counts.sum(axis=0).tolist()
        for wanted in range(1, int(counts[:, 0].sum()) + 1):
            at, before = tree.before_reaching(wanted)
            assert before.tolist() == counts[:at].sum(axis=0).tolist()
            assert before[0] < wanted <= before[0] + counts[at, 0]


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, low, high = plain_cuts(text, h[0], h[1])
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = hard_rows()
    for k in range(100, 160):
        rows.append((k, f"one <  two\n\n dréi🙂 {'four ' * k}< <S <M"))
    rows += [(k, f"has {mark} inside") for k, mark in enumerate(("<P>", "<S>", "<M>"), 200)]
    docs = documents(spark, rows)
    found = infill.fill_in_middle(docs).select(
        "*", infill.restored(infill.F.col("output"), infill.F.col("form")).alias("text")
    )
    got = [tuple(r) for r in found.collect()]
    want = [(*plain(i, t), t or "") for i, t, *_ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(documents(spark, [])).count() == 0


def test_marks_that_could_be_cut_in_two_ways_are_refused():
    infill.check_marks(infill.MARKS)
    for marks in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("ab", "bc", "x"), ("a<S>b", "<S>", "x"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.check_marks(marks)
