"""Exact dedup, tokens and packing."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docket_spark.llm import exact_dedup, packing, tokens
from tests.llm.tables import PROSE, documents, hard_rows

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F)) | st.text())
def test_ids_are_those_of_the_library(text):
    assert tokens.encoder(BPE).ids([text])[0].tolist() == library_ids(text)


def test_long_texts_are_cut_at_safe_places():
    text = " ".join(f"word{k}'s,\n\n  next" for k in range(9000)) + "<|endoftext|>tail"
    assert len(tokens.safe_parts(text)) > 1
    assert "".join(tokens.safe_parts(text)) == text
    for long in (text, text + "語", "x" * 70_000):
        assert tokens.encoder(BPE).ids([long])[0].tolist() == library_ids(long)


def test_token_counts(spark):
    rows = hard_rows()
    found = tokens.token_counts(documents(spark, rows), BPE).collect()
    assert len(found) == len(rows)
    want = collections.Counter(
        (i, len((t or "").encode()), n := len(library_ids(t or "")), n > 512) for i, t, _ in rows
    )
    assert collections.Counter(tuple(r) for r in found) == want


def test_exact_duplicates(spark):
    rows = [
        (1, "Same Text"),
        (4, "same text"),
        (3, "SAME TEXT"),
        (5, "same  text"),
        (6, None),
        (7, ""),
        (None, "same text"),
        (8, "ÀB"),
        (9, "àb"),
        (10, "Àb"),
    ]
    found = {
        r.doc_id: (r.keep_id, r.group_size, r.kept)
        for r in exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    }
    assert found == {
        1: (4, 4, False),
        3: (4, 4, False),
        4: (4, 4, True),
        None: (4, 4, False),
        5: (5, 1, True),
        6: (7, 2, False),
        7: (7, 2, True),
        8: (10, 2, False),
        9: (9, 1, True),
        10: (10, 2, True),
    }
    smallest = exact_dedup.exact_duplicates(documents(spark, rows), keep="smallest")
    assert {r.keep_id for r in smallest.collect()} == {1, 5, 6, 8, 9}


def test_equal_hashes_of_different_texts_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda text: F.lit("00" * 16))
    found = exact_dedup.exact_duplicates(documents(spark, [(1, "a"), (2, "b"), (3, "A")])).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {(1, 3), (2, 2), (3, 3)}


def test_deduplicate_keeps_columns_and_one_row_of_repeats(spark):
    docs = documents(spark, [*hard_rows(), (9, PROSE.upper(), "en")])
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [3, 4, 5, 6, 7, 8, 9]


def pieces(text, capacity):
    ids = [*library_ids(text or ""), 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])], cuts


def test_packing_round_trip(spark):
    capacity, rows = 64, [r for r in hard_rows() if r[0] not in (5, None, 1)] + [(1, PROSE)]
    rows += [(100 + k, " word" * k) for k in range(60)]
    found = packing.pack(documents(spark, rows), BPE, capacity).collect()
    texts = dict((r[0], r[1]) for r in rows)
    by_sequence = collections.defaultdict(list)
    seen = collections.Counter()
    for r in found:
        parts, cuts = pieces(texts[r.doc_id], capacity)
        assert (r.start, r.length) == (cuts[r.piece], len(parts[r.piece]))
        assert r.ids_crc32 == zlib.crc32(np.array(parts[r.piece], "<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += 1
    assert seen == {i: len(pieces(t, capacity)[0]) for i, t in texts.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in found)
    assert len(by_sequence) <= total / capacity * 1.1 + 1


def test_a_frequent_length_gets_more_salts_and_no_two_pieces_one_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTS", 2)
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    rows = [(k, " word" * (29 if k % 3 else k % 31)) for k in range(1500)]
    docs = documents(spark, rows)
    found = packing.pack(docs, BPE, 64).collect()
    lengths = collections.Counter(r.length for r in found)
    assert lengths[30] >= 1000
    salted = packing._salted(packing.pieces_of(docs, BPE, 64), dict(lengths))
    groups = collections.Counter((r.length, r.salt) for r in salted.collect())
    assert len({s for n, s in groups if n == 30}) > 20 and max(groups.values()) < 120
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    assert sorted(r.doc_id for r in found) == list(range(1500))


def test_plan_holds_every_piece_and_is_tight():
    draw = random.Random(4)
    for capacity in (1, 2, 3, 7, 50, 2048):
        for _ in range(15):
            counts = {n: draw.randint(1, 30) for n in range(1, capacity + 1) if draw.random() < 0.4}
            held, sequences = collections.Counter(), 0
            for many, kind in packing.plan_sequences(counts, capacity):
                assert sum(n * times for n, times in kind) <= capacity
                assert sum(times for n, times in kind if 3 * n > capacity) <= 2
                sequences += many
                for n, times in kind:
                    held[n] += many * times
            assert held == counts
            # First fit decreasing, piece by piece, is not better by more than a hundredth.
            gaps = []
            for n in sorted(counts, reverse=True):
                for _ in range(counts[n]):
                    k = next((k for k, gap in enumerate(gaps) if gap >= n), None)
                    if k is None:
                        gaps.append(capacity - n)
                    else:
                        gaps[k] -= n
                if len(gaps) > 3000:
                    break
            else:
                assert sequences <= len(gaps) * 1.01 + 1


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert tokens.token_counts(none, BPE).count() == 0
    assert packing.pack(none, BPE).count() == 0
