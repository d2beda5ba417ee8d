import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, nothing
from trackframe.llm import langid, quality, toxicity
from trackframe.llm.common import in_fold, read
from trackframe.llm.sampling import class_sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, SF, "documents"), read(spark, SF, "labels")


def held_out_rows(scored, labels, name):
    rows = scored.filter(in_fold("doc_id", 3, 1)).join(labels, "doc_id").select("score", name).collect()
    score = np.array([r["score"] for r in rows])
    label = np.array([r[name] for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    return score, label


def test_quality_on_the_held_out_fold(spark, tables):
    docs, labels = tables
    model = quality.quality_model(docs, labels)
    score, label = held_out_rows(quality.score_quality(docs, model), labels, "quality")
    assert ((score >= 0.5) == (label == 1)).mean() > 0.97


def test_toxicity_on_the_held_out_fold(spark, tables):
    docs, labels = tables
    model = toxicity.toxicity_model(docs, labels)
    score, label = held_out_rows(toxicity.score_toxicity(docs, model), labels, "toxic")
    assert (score[label == 1] >= 0.7).mean() > 0.85
    assert (score[label == 0] >= 0.7).mean() < 0.04


def test_language_on_the_held_out_fold(spark, tables):
    docs, _ = tables
    judged = langid.predict_language(docs, langid.language_model(docs))
    rows = judged.filter(in_fold("doc_id", 5, 0) & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def models():
    good = [(f"the quiet river runs past house number {i} and the mill", 1) for i in range(40)]
    bad = [("BUY!! NOW!! " * (5 + i % 7), 0) for i in range(40)]
    rude = [(f"you are such an idiot and a moron number {i}", 1) for i in range(40)]
    kind = [(f"you are such a friend and a helper number {i}", 0) for i in range(40)]
    tongue = [("der die das und nicht eine schöne straße", "de"), ("the and of that this with", "en")]
    return (
        quality.fit(good + bad), toxicity.fit(rude + kind), langid.fit(tongue * 40, epochs=30)
    )


def test_awkward_rows(spark, models):
    docs = awkward(spark)
    for scored in (
        quality.score_quality(docs, models[0]), toxicity.score_toxicity(docs, models[1]),
        langid.predict_language(docs, models[2]),
    ):
        rows = scored.collect()
        assert len(rows) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert set(docs.columns) <= set(scored.columns)
        same = [r["score"] for r in rows if r["doc_id"] == 4]
        assert abs(same[0] - same[1]) < 1e-9
    toxic = toxicity.score_toxicity(docs, models[1]).filter("doc_id <= 2").collect()
    assert all(r["score"] == 0 for r in toxic)  # no words
    langs = {r["doc_id"]: r for r in langid.predict_language(docs, models[2]).collect()}
    for i in (0, 1, 2, 7):  # null, empty, blank, without a letter
        assert (langs[i]["lang_pred"], langs[i]["score"]) == ("und", 0.0)


def test_one_insult_in_a_long_text_and_misspelt(models):
    calm = "you are such a friend and a helper " * 200
    low, high, odd = models[1].scores([calm, calm + "idiot " + calm, "you are such an idiiot and mooron"])
    assert low < 0.5 < high and odd > 0.5


def test_last_window_counts(models):
    german = "der die das und nicht eine schöne straße " * 40
    english = "the and of that this with " * 60
    assert models[2].predict([german, english])[0] == ["de", "en"]
    assert models[2].predict([german + english * 5])[0] == ["en"]


@pytest.mark.parametrize("docs", [nothing, awkward])
def test_nothing_to_learn_from(spark, docs):
    docs = docs(spark)
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality_model(docs, labels) is None
    assert toxicity.toxicity_model(docs, labels) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} <= {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} <= {0.0}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.language_model(unknown) is None
    assert {r["lang_pred"] for r in langid.predict_language(docs, None).collect()} <= {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = awkward(spark, [(i, "some text", "en", "a") for i in ids])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert quality.quality_model(docs, labels) is None
    assert toxicity.toxicity_model(docs, labels) is None


@pytest.mark.parametrize("length", [1, 4, 5, 59, 60, 61, 64, 65, 115, 116, 117, 1000])
def test_every_part_of_a_long_run_is_read(length):
    run = "".join(chr(0x4E00 + i) for i in range(length))
    pieces = toxicity.words_of(f"a {run} b")
    assert pieces[0] == "a" and pieces[-1] == "b"
    pieces = pieces[1:-1]
    assert all(0 < len(p) <= toxicity.LONGEST_WORD for p in pieces)
    for n in range(1, toxicity.LONGEST + 1):
        grams = {p[i : i + n] for p in pieces for i in range(len(p) - n + 1)}
        assert grams == {run[i : i + n] for i in range(length - n + 1)}
    assert pieces == [run] or length > toxicity.LONGEST_WORD


def test_insults_behind_the_first_characters_of_a_run_count(models):
    rude, kind = "_you_are_such_an_idiot_and_a_moron" * 4, "_you_are_such_a_friend_and_a_helper" * 4
    model = models[1]
    start = kind[:70]
    bad, good = model.scores([start + rude, start + kind])
    assert bad > 0.6 > 0.5 > good
    assert model.scores([start])[0] < 0.5


def test_no_class_is_left_out_of_the_sample(spark):
    sizes = {f"l{k:03}": 300 if k < 20 else 1 + k % 7 for k in range(150)}
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, label string").cache()
    got = [r["label"] for r in class_sample(docs, 10).collect()]
    assert set(got) == set(sizes)
    assert len(got) <= 64 * 10 * 1.2
    one = class_sample(docs, 1).collect()  # less than a row for each class
    assert {r["label"] for r in one} == set(sizes) and len(one) < 2 * len(sizes)


def test_rare_languages_are_learned_among_many(spark):
    rows = [
        (k * 10 + i, chr(97 + k % 26) * 3 + chr(97 + k // 26) * 3, f"l{k:03}", "s")
        for k in range(80) for i in range(8 if k < 70 else 4)
    ]
    model = langid.language_model(awkward(spark, rows), per_class=3)
    assert set(model.classes) == {r[2] for r in rows}


@pytest.mark.parametrize("sign", [" ", "_", "-", ".", ""])
def test_one_insult_in_a_long_text_without_spaces(models, sign):
    calm = "you are such a friend and a helper " * 50
    low, high = models[1].scores([t.replace(" ", sign) for t in (calm, calm + "idiot " + calm)])
    assert low < 0.5 and high > 0.7


def test_every_byte_of_a_window_and_every_border_is_read(models):
    """A byte that changes anywhere changes some place that a filter sees, in both windows of a border."""
    net = models[2]
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, langid.LENGTH + 40, dtype=np.uint8))
    windows = langid.windows_of(data)
    assert len(windows) == 2
    for at in range(len(data)):
        other = langid.windows_of(data[:at] + b"~" + data[at + 1 :])
        changed = [k for k in range(2) if (net.patches(windows[k : k + 1]) != net.patches(other[k : k + 1])).any()]
        inside = [k for k in range(2) if k * langid.STEP <= at < k * langid.STEP + langid.LENGTH]
        assert changed == inside and inside
    # every run as long as the widest filter lies inside a window
    widest = max(langid.WIDTHS)
    for at in range(len(data) - widest + 1):
        assert any(data[at : at + widest] in bytes(w) for w in windows)


@pytest.mark.parametrize("length", [0, 1, 123, 124, 127, 128, 129, 252, 253, 500])
def test_windows_hold_the_whole_text_once(length):
    data = bytes(i % 251 + 1 for i in range(length))
    windows = langid.windows_of(data)
    joined = b"".join(bytes(w[: langid.STEP]) for w in windows[:-1]) + bytes(windows[-1])
    assert joined.rstrip(b"\0") == data
    assert len(windows) == 1 or len(data) > (len(windows) - 2) * langid.STEP + langid.LENGTH


def plain_language(net, text):
    """Filters at every byte, one number at a time."""
    data = text.encode()
    widest, means, weights = max(langid.WIDTHS), [], []
    starts = range(0, max(len(data) - langid.LENGTH + langid.STEP, 1), langid.STEP)
    for k, start in enumerate(starts):
        window = list(data[start : start + langid.LENGTH])
        window += [0] * (langid.LENGTH - len(window))
        hidden = []
        for f in range(net.kernel.shape[1]):
            best = -np.inf
            for at in range(langid.LENGTH):
                value = sum(
                    float(net.embed[window[at + w], d]) * float(net.kernel[w * langid.DIM + d, f])
                    for w in range(widest) if at + w < langid.LENGTH for d in range(langid.DIM)
                )
                best = max(best, value)
            hidden.append(max(best + float(net.shift[f]), 0.0))
        logits = np.array(hidden) @ net.out + net.bias
        logits = logits - logits.max()
        means.append(logits - np.log(np.exp(logits).sum()))
        weights.append(langid.STEP if k < len(starts) - 1 else len(data) - langid.STEP * k)
    mean = np.average(means, axis=0, weights=weights)
    probs = np.exp(mean - mean.max())
    return net.classes[int(probs.argmax())], float((probs / probs.sum()).max())


def test_language_equals_a_plain_forward_pass(models):
    for text in ("die schöne", "the and of " * 14):
        (lang,), (score,) = models[2].predict([text])
        want, share = plain_language(models[2], text)
        assert lang == want and abs(score - share) < 1e-4


def plain_toxicity(model, text):
    """N-grams hashed and averaged one by one; the worst window."""
    def row(codes, n):
        value = 0
        for c in codes:
            value = (value * 1_000_003 + c + 1) % 2**64
        return value + n

    def hashed(value):
        return (value * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.BUCKETS

    def value(word):
        codes = [ord(c) for c in f"<{word}>"]
        grams = [
            hashed((row(codes[i : i + n], n)) % 2**64)
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for i in range(len(codes) - n + 1)
        ]
        whole = sum((c + 1) * 31 ** (i + 1) for i, c in enumerate(codes)) % 2**64
        return np.mean([model.rows[g] for g in [*grams, hashed(whole)]])

    values = [value(w) for w in toxicity.words_of(text)]
    size = min(len(values), toxicity.WINDOW)
    worst = max(np.mean(values[i : i + size]) for i in range(len(values) - size + 1))
    return 1 / (1 + np.exp(-(worst + model.bias)))


def test_toxicity_equals_a_plain_pass(models):
    texts = ["an idiot", "you are such a helper and a moron, my friend", "x", "schöne_straße_" * 9]
    for text, score in zip(texts, models[1].scores(texts)):
        assert abs(score - plain_toxicity(models[1], text)) < 1e-5


def plain_quality(model, text):
    """Passages one after the other: class shares, gate, weighted sum."""
    words = text.split(" ")
    hidden, gates = [], []
    for at in range(0, len(words), quality.WORDS):
        some = words[at : at + quality.WORDS]
        lower = [w.lower() for w in some]
        piece, n = " ".join(some), len(some)
        shares = np.zeros(quality.CLASSES.shape[1])
        for byte in piece.encode():
            shares += quality.CLASSES[byte]
        stats = [
            n / quality.WORDS, len(set(lower)) / n, sum(a == b for a, b in zip(lower, lower[1:])) / n,
            sum(w.isupper() for w in some) / n, len(piece) / n / 10, piece.count("\n") / n,
        ]
        x = np.concatenate([np.sqrt(shares / max(len(piece.encode()), 1)), stats])
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        h = np.tanh(x @ model.we + model.be)
        hidden.append(h)
        gates.append(np.tanh(h @ model.v) / (1 + np.exp(-(h @ model.u))) @ model.a)
    weights = np.exp(np.array(gates) - max(gates))
    z = (weights / weights.sum()) @ np.array(hidden)
    return 1 / (1 + np.exp(-(z @ model.c + model.b[0])))


def test_quality_equals_a_plain_pass(models):
    texts = ["", "the quiet river " * 60, "BUY!! NOW!! " * 20 + "house \n number", "x  y " * 130]
    for text, score in zip(texts, models[0].scores(texts)):
        assert abs(score - plain_quality(models[0], text)) < 1e-4
