"""Cases that a cut in an operator would lose: each failed before the cut was undone."""

import itertools
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from swathgrid.llm import decontaminate, licenses, line_dedup


def documents(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts)), "doc_id long, text string")


def shingles(text, size=8):
    return frozenset(text[k : k + size] for k in range(max(1, len(text) - size + 1)))


def test_lines_alike_in_the_first_characters_of_words_stay(spark):
    apart = ["https://a.com/x", "https://b.org/y", "checksum 0123456789abcdef01", "checksum 01234567ffffffff99", "Donaudampfschifffahrt", "Donaudampfkesselbauer"]
    far = "x" + "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    out = line_dedup.line_classes(documents(spark, [*apart, far, "y" + far[1:]])).collect()
    assert {r.doc_id for r in out if r.kept} == {0, 1, 2, 3, 4, 5, 6}
    assert {r.keep_doc_id for r in out if r.doc_id == 7} == {6}  # one word that differs in its first character only


def test_line_classes_against_shingles_at_every_position(spark, small):
    lines = defaultdict(list)
    for r in pq.read_table(f"{small}/documents.parquet").to_pylist():
        for k, x in enumerate((r["text"] or "").split("\n")):
            if x := x.strip(" \t\r\v\f").lower():
                lines[x].append((r["doc_id"], k))
    texts = sorted(lines)
    sets = [shingles(x) for x in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for who in holders.values():
        for pair in itertools.combinations(who, 2):
            shared[pair] += 1
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    first = {}
    for i, x in enumerate(texts):
        first[root(i)] = min(first.get(root(i), min(lines[x])), min(lines[x]))
    want = {at: first[root(i)] for i, x in enumerate(texts) for at in lines[x]}
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_classes(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert set(got) == set(want) and len(set(want.values())) < len(texts)
    assert sum(got[at] != want[at] for at in want) <= 0.001 * len(want)


def test_adjacent_notices_are_found():
    prose = "the river ran past a mill and the people of the village came to see what it had brought them in that long wet spring"
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    for name in ("MIT", "Apache-2.0-notice", "GPL-3.0-notice", "BSD-2-Clause"):
        for copies, between in ((2, 0), (2, 5), (2, 20), (3, 0), (3, 5)):
            text = " ".join([prose, (" " + "stone " * between).join([licenses.TEMPLATES[name]] * copies), prose])
            assert [f[1] for f in scanner.scan(text.encode()) if f[0] == name] == [1.0], (name, copies, between)


def test_blocks_judge_each_row_alone(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs", "deep dark wood behind the old mill and more words here"
    texts = [f"one {a}", f"two {b}", "three", f"{a} {b}", a + "\n", f"four {b}", None, a + " \x0b\x1c", f"one {a}"]
    docs = documents(spark, texts, [1, 1, 1, None, 2, None, None, 3, 1])
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    found = [sorted(map(str, decontaminate.find_contamination(docs, bench, key="doc_id", block_bytes=size).collect())) for size in (1 << 20, 10)]
    assert found[0] == found[1] and len(found[1]) == len(texts)
    left = [sorted(map(str, decontaminate.decontaminate(docs, bench, block_bytes=size).collect())) for size in (1 << 20, 10)]
    assert left[0] == left[1] and len(left[1]) == 6


def test_the_letter_f_is_no_form_feed(spark):
    out = line_dedup.line_classes(documents(spark, ["f", "0f", "0", "auf", "au", "\fau"])).collect()
    assert {r.doc_id for r in out} == set(range(6)) and {r.doc_id for r in out if r.kept} == {0, 1, 2, 3, 4}


def crowd():
    """Lines of one template whose shingles many other lines share, the links among them, and the root of each."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    template, pool = " ".join(word() for _ in range(22)), [[word() for _ in range(6)] for _ in range(10)]
    texts = set()
    for _ in range(150):
        at = r.integers(0, 6, 10)
        other = at.copy()
        other[r.integers(0, 10)] += 1
        texts.update(" ".join([template, *(pool[k][v % 6] for k, v in enumerate(x))]) for x in (at, other))
    texts = sorted(texts)
    sets = [shingles(x) for x in texts]
    links = [(a, b) for b, a in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= line_dedup.THRESHOLD * len(sets[a] | sets[b])]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return texts, links, {i: root(i) for i in up}


def test_every_pair_of_a_crowded_band_is_compared(spark, monkeypatch):
    """pairs of a template's lines whose shingles many other lines share, too; bands of several blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    monkeypatch.setattr(line_dedup, "AT_ONCE", 0)  # rounds of ends first
    texts, links, root = crowd()
    got = {x.doc_id: x.keep_doc_id for x in line_dedup.line_classes(documents(spark, texts)).collect()}
    assert len(set(root.values())) > 100 and all(root[got[i]] == root[i] for i in root)
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)


def test_repeats_within_a_line_do_not_count(spark):
    out = line_dedup.line_classes(documents(spark, ["-" * 8, "-" * 9, "-" * 10, "-" * 40, "+-" * 6, "+-" * 20])).collect()
    assert {x.doc_id for x in out if x.kept} == {0, 4}


def test_the_line_stage_of_the_pipeline_compares_a_crowd(spark):
    """one document is left of each component."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, _, root = crowd()
    left = corpus_pipeline.drop_repeated_lines(spark, documents(spark, texts), "").collect()
    assert {x.doc_id for x in left} == set(root.values())


def test_a_pair_of_a_crowd_comes_once(spark, monkeypatch):
    """Lines of a crowd share several bands: their pairs came once for each."""
    texts, links, root = crowd()
    came, across = [], line_dedup._across
    monkeypatch.setattr(line_dedup, "_across", lambda *args: came.append(across(*args).collect()) or across(*args))
    got = {x.doc_id: x.keep_doc_id for x in line_dedup.line_classes(documents(spark, texts)).collect()}
    assert came and all(len(pairs) == len(set(pairs)) for pairs in came)
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links) and all(root[got[i]] == root[i] for i in root)


def test_lines_inside_the_largest_component_do_not_meet(spark):
    """pairs across a band's components are made from the lines outside its largest one, each pair once."""
    lines = [(band, lid, 1 if lid < 5 else lid) for band in (7, 8) for lid in range(1, 7)] + [(9, 1, 1), (9, 2, 1)]
    rows = line_dedup.written(spark.createDataFrame(lines, "band long, lid long, c long"), "rows")
    words = ", ".join(f"w{k} long" for k in range(line_dedup.WORDS))
    bitmaps = line_dedup.written(spark.createDataFrame([(lid, 9, *[0] * line_dedup.WORDS) for lid in range(1, 7)], f"lid long, n long, {words}"), "bitmaps")
    opened = line_dedup.written(line_dedup._open(rows, bitmaps), "open")
    assert {x.lid for x in opened.where("c <> main").collect()} == {5, 6} and opened.count() == 12
    pairs = sorted((x.a, x.b) for x in line_dedup._across(opened, line_dedup.THRESHOLD, 0).collect())
    assert pairs == [(a, b) for a in (5, 6) for b in range(1, a)]


def test_only_documents_that_may_change_are_shuffled(spark, monkeypatch):
    """the texts of all documents met the lines that went, and the doc_ids that stay."""
    from swathgrid.llm import simhash

    word = lambda k: "".join(chr(97 + k * j % 26) + chr(97 + (k // 26 + j) % 26) for j in (3, 5, 7, 11, 17))
    texts = [" ".join(word(k * 31 + j) for j in range(30)) for k in range(40)]
    docs, hits = documents(spark, [*texts, "one\n" + texts[3], texts[4], None, ""]), []
    for module in (line_dedup, simhash):
        keep = lambda *args, marked=module.marked: hits.append(marked(*args)) or hits[-1]
        monkeypatch.setattr(module, "marked", keep)
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()} == {**dict(enumerate(texts)), 40: "one", 42: None, 43: ""}
    assert hits[-1].where("hit").count() <= 6
    assert {x.doc_id for x in simhash.one_of_each(docs).collect()} == {*range(40), 42} and hits[-1].where("hit").count() <= 6
