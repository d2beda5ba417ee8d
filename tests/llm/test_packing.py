import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.data import awkward, nothing, texts_of
from trackframe.llm import packing
from trackframe.llm.packing import LENGTH, Mixture, Schedule, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("totals", [[5000, 300, 0, 7, 20000, 1], [10], [4096], [1, 1, 1], [12345] * 3])
@pytest.mark.parametrize("even", [True, False])
def test_schedule_serves_whoever_is_furthest_behind(totals, even):
    schedule = Schedule(totals, [1.0] * len(totals) if even else None)
    turns = sorted(((x + 0.5) / schedule.weights[q], q) for q, n in enumerate(totals) for x in range(n))
    queues = np.array([q for _, q in turns])
    windows = np.arange(sum(totals) // LENGTH + 14)
    borders = schedule.borders(windows)
    got = schedule.taken(borders)
    for border, row in zip(borders, got, strict=True):
        assert row.tolist() == np.bincount(queues[:border], minlength=len(totals)).tolist()
    places = np.arange(sum(totals))
    assert (schedule.window_of(places) == np.searchsorted(borders, places, side="right") - 1).all()


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 5.0}])
def test_every_token_is_in_one_piece(spark, targets):
    docs = awkward(spark)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(
        (-1 if i is None else i, s or "", tuple(tokenizer.encode(t, add_special_tokens=False).ids + [2]))
        for i, t, s in texts_of(docs)
    )
    rows = pack_documents(docs, PATH, targets).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(-1 if r["doc_id"] is None else r["doc_id"], r["source"] or "", r["doc_tokens"])].append(r)
    sizes = []
    for _, spans in sorted(windows.items()):
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    full = sum(len(ids) for _, _, ids in want) // LENGTH
    assert sizes[:full] == [LENGTH] * full
    assert all(n & (n - 1) == 0 for n in sizes[full:])
    assert sum(sizes) == sum(len(ids) for _, _, ids in want)
    for i, s, ids in set(want):
        copies = sum(w == (i, s, ids) for w in want)
        starts = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[(i, s, len(ids))])
        data = np.array(ids, "<u4")
        covered = np.zeros(len(ids), int)
        for start, length, crc in starts:
            covered[start : start + length] += 1
            assert crc == zlib.crc32(data[start : start + length].tobytes())
        assert (covered == copies).all()


def test_windows_have_the_mixture(spark):
    docs = awkward(spark, [(i, "wort " * 3000, None, "ab"[i % 2]) for i in range(8)])
    rows = pack_documents(docs, PATH, {"a": 3.0, "b": 1.0}).collect()
    first = defaultdict(int)
    for r in rows:
        if r["sequence_id"] == 0:
            first[r["source"]] += r["length"]
    assert first == {"a": 3072, "b": 1024}


def test_empty_table(spark):
    assert pack_documents(nothing(spark), PATH).count() == 0


@pytest.mark.parametrize("many", [3, 7, 40])
@pytest.mark.parametrize("even", [True, False])
def test_queues_in_groups_of_groups_are_served_in_step(monkeypatch, many, even):
    monkeypatch.setattr(packing, "QUEUES", 3)
    monkeypatch.setattr(packing, "WINDOWS", 2)
    rng = np.random.default_rng(many)
    totals = np.sort(rng.integers(1, 3000, many))[::-1].tolist()
    weights = rng.uniform(0.2, 5, many) if even else np.array(totals, float)
    mixture = Mixture(totals, weights.tolist() if even else None)
    queue = np.repeat(np.arange(many), 2)
    half = np.array(totals) // 2
    start = np.stack([np.zeros(many, int), half], axis=1).ravel()
    length = np.stack([half, totals - half], axis=1).ravel()
    keep = length > 0
    run, window, offset, begin, size = mixture.pieces(queue[keep], start[keep], length[keep])
    # every token once, windows full and without gaps
    tokens = defaultdict(int)
    for r, n in zip(run.tolist(), size.tolist(), strict=True):
        tokens[int(queue[keep][r])] += n
    assert tokens == dict(enumerate(totals))
    for w in np.unique(window):
        spans = sorted(zip(offset[window == w].tolist(), size[window == w].tolist(), strict=True))
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
        full = np.diff(mixture.root.borders(np.array([w, w + 1])))[0]
        assert sum(n for _, n in spans) == full
    # each queue has its share before every border, up to a few tokens
    flat = Schedule(totals, weights.tolist())
    for w in np.unique(window):
        want = flat.taken(flat.borders(np.array([w + 1])))[0]
        got = np.bincount(queue[keep][run[window <= w]], size[window <= w], many)
        assert np.abs(got - want).max() <= 8


def test_targets_count_for_every_source(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    docs = awkward(spark, [(i, "wort " * 6000, None, "abcdef"[i % 6]) for i in range(12)])
    targets = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0, "f": 3.0}
    first = defaultdict(int)
    for r in pack_documents(docs, PATH, targets).collect():
        if r["sequence_id"] == 0:
            first[r["source"]] += r["length"]
    assert set(first) == set("abcdef")
    assert all(abs(n - 512 * targets[s]) <= 6 for s, n in first.items())


def test_strings_of_added_tokens_are_those_of_the_library():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["hello <|endoftext|> world", "plain words", "a<|startoftext|>b", "<|ENDOFTEXT|>", "", "<|endoftext|>"]
    got = packing.tokens_at(PATH).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [
        [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for t in texts
    ]
    assert got[0].tolist()[:3] == [3306, 49407, 1002]
