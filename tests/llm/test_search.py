"""Decontamination and substring dedup against plain searches."""

import random
import re

import numpy as np

from docket_spark.llm import decontaminate, queries, repeats, words
from tests.llm.tables import PROSE, documents, hard_rows


def plain_edits(item, text):
    """Least edits between ``item`` and any stretch of ``text``."""
    above = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(text):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def plain_words(text):
    return re.findall(r"\w+", (text or "").lower())


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_edits_equal_the_plain_table():
    draw = random.Random(10)
    for _ in range(300):
        item = [draw.randrange(4) for _ in range(draw.randint(1, 9))]
        text = [draw.randrange(4) for _ in range(draw.randint(0, 15))]
        cost, start, end = decontaminate.edits_within(
            np.array(item, np.uint64), np.array(text, np.uint64), 99
        )
        assert cost == plain_edits(item, text)
        whole = list(range(end - start + 1))
        for i, x in enumerate(item):
            row = [i + 1]
            for j, y in enumerate(text[start:end]):
                row.append(min(whole[j] + (x != y), whole[j + 1] + 1, row[j] + 1))
            whole = row
        assert whole[-1] == cost


def test_leaks_equal_a_search_of_every_place(spark):
    draw = random.Random(11)
    vocabulary = [f"word{k}" for k in range(300)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(8, 40)))) for k in range(12)]
    items += [(100, None), (101, "too short"), (None, " ".join(vocabulary[:15]))]
    rows = [r for r in hard_rows() if r[0] not in (None, 1, 5)]
    for k in range(120):
        item = draw.choice([x for x in items if x[1] and x[0] != 101])[1].split()
        for _ in range(draw.randint(0, len(item) // 4)):
            at = draw.randrange(len(item))
            item[at : at + draw.randint(0, 2)] = draw.choices(vocabulary, k=draw.randint(0, 1))
        around = draw.choices(vocabulary, k=60)
        rows.append((200 + k, "... ".join([*around[:30], *item, *around[30:]]).upper()))
    found = decontaminate.leaks(documents(spark, rows), benchmark(spark, items)).collect()
    want = {
        (i, item): edits
        for i, text, *_ in rows
        for item, own in items
        if len(size := plain_words(own)) >= 8
        and (edits := plain_edits(size, plain_words(text))) <= len(size) // 5
    }
    assert len(want) > 60
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    assert len(got) == len(found) and not got.keys() - want.keys()
    assert len(got) >= 0.98 * len(want)
    assert all(want[k] == edits for k, edits in got.items())


def test_keep_clean(spark, monkeypatch):
    items = [(1, PROSE), (2, "a b c d e f g h i j"), (3, "never seen words that no text has at all")]
    docs = documents(spark, [*hard_rows(), (20, "A, b; c d e f g x i j!"), (21, "a b c d")])
    for size in (decontaminate.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        kept = decontaminate.keep_clean(docs, benchmark(spark, items))
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("2 3 4 None 5 6 7 8 21".split())
        assert decontaminate.leaks(docs, benchmark(spark, items)).count() == 4
    assert decontaminate.keep_clean(docs, benchmark(spark, [])).count() == docs.count()
    assert decontaminate.leaks(documents(spark, []), benchmark(spark, items)).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sentences(text):
    """Sentences as lists of (start, end, word)."""
    found, own = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if own and "\n" in text[own[-1][1] : m.start()]:
            found.append(own)
            own = []
        own.append((m.start(), m.end(), m[0].translate(LOWER)))
        if m[0][-1] in ".!?":
            found.append(own)
            own = []
    cut = []
    for sentence in [*found, own]:
        hashes = [words.runs([w[2].encode()], repeats._WORD)[3][0] for w in sentence]
        ends = set()
        margin, stretch = repeats.MARGIN, repeats.STRETCH
        for a in range(margin, len(sentence) - margin - stretch + 1):
            ends.add(min(range(a, a + stretch), key=lambda i: (hashes[i], -i)))
        part = []
        for i, word in enumerate(sentence):
            part.append(word)
            if i in ends:
                cut.append(part)
                part = []
        cut.append(part)
    return [x for x in cut if x]


def plain_repeats(rows, least, both_ends):
    """id to the merged places that an earlier span has."""
    first, places = set(), {}
    for i, text in sorted(rows):
        sentences = plain_sentences(text)
        sizes = [len(s) for s in sentences]
        chosen = set()
        for k in range(len(sentences)):
            ahead = [j for j in range(k + 1, len(sentences)) if sum(sizes[k : j + 1]) >= least]
            behind = [j for j in range(k) if sum(sizes[j : k + 1]) >= least]
            if ahead:
                chosen.add((k, ahead[0]))
            if behind and both_ends:
                chosen.add((behind[-1], k))
        for k, j in sorted(chosen):
            span = tuple(w[2] for s in sentences[k : j + 1] for w in s)
            if span in first:
                places.setdefault(i, []).append((sentences[k][0][0], sentences[j][-1][1]))
            first.add(span)
    merged = {}
    for i, found in places.items():
        out = []
        for a, b in sorted(found):
            if out and out[-1][1] >= a - 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        merged[i] = [tuple(x) for x in out]
    return merged


def test_repeats_equal_a_plain_search(spark):
    draw = random.Random(12)
    stock = [
        " ".join(draw.choices(["Été", "of", "THE", "x", "🙂", "word"], k=draw.randint(1, 70)))
        + draw.choice([". ", "!\n", " \n ", "? ", ", "])
        for _ in range(60)
    ]
    rows = [(k, "".join(draw.choices(stock, k=draw.randint(0, 12)))) for k in range(150)]
    docs = documents(spark, [*rows, (None, None), (900, None), (901, "")])
    for least in (6, repeats.LEAST_WORDS):
        for both_ends in (False, True):
            want = plain_repeats(rows, least, both_ends)
            found = repeats.repeats(docs, least_words=least, both_ends=both_ends).collect()
            assert {r.doc_id: [tuple(x) for x in r.removed] for r in found} == want
            assert all(r.first_doc_id <= r.doc_id for r in found)


def test_a_passage_goes_wherever_it_stands(spark):
    draw = random.Random(13)
    invent = lambda n: " ".join(
        "".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(n)
    )
    caught = 0
    for k in range(30):
        passage = ". ".join(invent(n) for n in draw.choice([[60], [20, 35], [9, 9, 9, 9, 9, 9], [26, 26]]))
        rows = [(2 * k, f"{invent(30)} {passage}. {invent(20)}"), (2 * k + 1, f"{invent(12)}. {invent(7)} {passage}. {invent(9)}")]
        got = repeats.repeats(documents(spark, rows)).collect() if k < 6 else None
        if got is not None:
            caught += [r.doc_id for r in got] == [2 * k + 1]
    assert caught == 6


def test_unpunctuated_passages_are_cut_alike_in_any_surroundings():
    draw = random.Random(14)
    invent = lambda n: ["".join(draw.choices("abcdefgh", k=6)) for _ in range(n)]
    for trial in range(300):
        passage = invent(draw.choice([51, 60, 200]))
        covered = []
        for _ in range(2):
            before, after = (invent(draw.choice([0, 5, 40])) for _ in range(2))
            stop = draw.choice(["", "."]) if before else ""
            text = " ".join([*before, *passage, *after]) if not stop else (
                " ".join(before) + ". " + " ".join([*passage, *after])
            )
            _, h1, h2, start, end = repeats.sentence_spans([text.encode()], 20, True)
            at = text.index(passage[0])
            covered.append({(a, b): (s - at, e - at) for a, b, s, e in zip(h1, h2, start, end)})
        shared = [covered[1][k] for k in covered[0].keys() & covered[1].keys()]
        assert shared, trial
        # At most a margin and a stretch are lost at each end; the words have 6 letters and a space.
        edge = 7 * (repeats.MARGIN + repeats.STRETCH)
        if len(passage) == 200:
            assert min(a for a, _ in shared) <= edge
            assert max(b for _, b in shared) >= 7 * 200 - 1 - edge


def test_remove_repeats(spark):
    rows = [*hard_rows(), (30, f"Before this. {PROSE} And after that."), (31, PROSE)]
    docs = documents(spark, rows)
    cut = repeats.remove_repeats(docs)
    assert cut.columns == docs.columns
    found = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(found) == len(rows)
    texts = dict(x for x in found if x[0] not in (None, 1))
    assert texts[30] == "Before this.  And after that." and texts[31] == ""
    assert [t for i, t in found if i == 1] == [PROSE, PROSE]
    assert texts[2] is None and texts[7] == "x" * 30_000
    none = documents(spark, [])
    assert repeats.remove_repeats(none).count() == repeats.repeats(none).count() == 0


def test_rows_that_share_an_id_keep_their_own_text(spark):
    other = " ".join(f"another{k} word" for k in range(40)) + ". " + "And one more sentence here."
    for shared in (2, None):
        rows = [(1, PROSE), (shared, PROSE), (shared, other), (shared, PROSE)]
        cut = repeats.remove_repeats(documents(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.text) for r in cut) == sorted(
            [("1", PROSE), (str(shared), ""), (str(shared), ""), (str(shared), other)]
        )


def test_short_sentences_at_the_end_of_a_repeated_passage_go(spark, tmp_path):
    words = iter(range(1000))
    say = lambda *sizes: " ".join(
        " ".join(f"w{next(words)}" for _ in range(n)) + "." for n in sizes
    )
    passage = say(5, 18, 5, 4)
    rows = [(1, f"{say(7)} {passage} {say(9)}"), (2, f"{say(8, 6)} {passage} {say(11)}")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()
    start = rows[1][1].index(passage)
    assert [(r.doc_id, r.removed) for r in found] == [(2, f"{start}:{start + len(passage)}")]


def test_items_of_one_template_are_told_apart(spark):
    """Stretches that all items share give places once, and the keys say which items are meant."""
    draw = random.Random(16)
    frame = [f"frame{k}" for k in range(12)]
    items = [
        (k, " ".join([*frame, *(f"own{k}x{j}" for j in range(6)), "the", "end"])) for k in range(300)
    ]
    items += [(1000 + k, items[k][1]) for k in range(3)]
    rows, want = [], set()
    for n in range(60):
        k = draw.randrange(300)
        own = items[k][1].split()
        own[draw.randrange(20)] = "other"
        around = [f"d{draw.randrange(99)}" for _ in range(30)]
        rows.append((n, " ".join([*around, *own, *around])))
        want |= {(n, k), (n, 1000 + k)} if k < 3 else {(n, k)}
    rows.append((500, " ".join([*frame, "the", "end"])))
    found = decontaminate.leaks(documents(spark, rows), benchmark(spark, items)).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert all(r.edits == 1 for r in found)


def test_short_items_leak_too(spark):
    draw = random.Random(15)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate((1, 2, 4, 5, 6, 7))]
    items.append((None, "..."))
    rows, want = [], set()
    for k, item in items[:-1]:
        for place in range(len(item.split())):
            own = item.split()
            own[place] = "other"
            around = [f"d{draw.randrange(99)}" for _ in range(20)]
            rows.append((100 * k + 2 * place, " ".join([*around, *own, *around])))
            rows.append((100 * k + 2 * place + 1, " ".join([*around, item, *around])))
            want.add((100 * k + 2 * place + 1, k, 0))
            if len(own) >= 5:
                want.add((100 * k + 2 * place, k, 1))
    docs = documents(spark, rows)
    found = decontaminate.leaks(docs, benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in found} == want
    assert decontaminate.keep_clean(docs, benchmark(spark, items)).count() == len(rows) - len(want)
