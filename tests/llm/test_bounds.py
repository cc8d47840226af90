"""What a call, a shard or the driver holds and does, in numbers that do not depend on the machine."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aisleframe.llm import jaccard, suffixes, toxicity
from aisleframe.llm.arrays import utf8
from aisleframe.llm.tokens import Encoder, default_path


def test_new_pieces_are_encoded_in_one_call(monkeypatch):
    encoder = Encoder(default_path())
    calls = []
    inner = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda text: calls.append(1) or inner(text))
    other = Tokenizer.from_file(default_path())
    texts = [" ".join(f"w{chr(97 + i % 26)}{i * 7919 % 1000}" for i in range(k, k + 500)) for k in range(0, 3000, 250)]
    texts += ["a\0b \0\0 c", "\0", "", "x\0<|endoftext|>\0", "<|endoftext|>", "plain words again"]
    for given in (texts[:9], texts[5:], texts[::-1], ["\0", "<|endoftext|>"]):
        ids, at = encoder(given)
        for i, t in enumerate(given):
            assert ids[at[i]:at[i + 1]].tolist() == other.encode(t, add_special_tokens=False).ids
    assert len(calls) <= 4


def test_runs_are_dealt_evenly():
    draw = np.random.default_rng(5)
    texts = pa.array(["".join(map(chr, draw.integers(97, 123, 4000))) for _ in range(50)])
    top = suffixes.Runs(*utf8(texts), 200).key >> np.uint64(61)
    assert np.bincount(top.astype(int), minlength=8).max() < 0.2 * len(top)


def test_suffixes_are_read_a_few_times_each(monkeypatch):
    """How often a suffix is read does not grow with the batches that come after its own."""
    read = [0]
    inner = suffixes.Level.keys

    def keys(self, *span):
        out = inner(self, *span)
        read[0] += len(out)
        return out

    monkeypatch.setattr(suffixes.Level, "keys", keys)
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    draw = np.random.default_rng(6)
    batches, each = 256, 100
    family = suffixes.Family(12, batches * each)
    texts = [draw.integers(97, 100, each + 11).astype(np.uint8) for _ in range(batches)]
    for i, text in enumerate(texts):
        family.add(text, np.arange(each), i * each)
    strings = [bytes(t[k:k + 12]) for t in texts for k in range(each)]
    seen = family.seen
    assert read[0] < 3 * batches * each * np.log2(batches)
    count = {}
    for s in strings:
        count[s] = count.get(s, 0) + 1
    assert seen.tolist() == [count[s] > 1 for s in strings] and 0 < seen.sum() < len(seen)


def test_training_holds_a_piece_of_its_words(monkeypatch):
    """Beside the texts, training holds the vocabulary and the words of one piece, not those of all texts."""
    monkeypatch.setattr(toxicity, "LANDMARKS", 60)
    draw = np.random.default_rng(7)
    vocab = np.array(["".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(400)])
    texts = [" ".join(draw.choice(vocab[:390], 4000)) + (" " + " ".join(vocab[390:]) if i % 2 else "") for i in range(1000)]
    texts = pa.array(texts)
    tracemalloc.start()
    table, bias, weights = toxicity.train(texts, [i % 2 for i in range(1000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights[0] > 0 and np.abs(table).max() > 0
    assert peak < 6 * texts.nbytes


def test_rounds_carry_packed_sets_and_open_shingles(spark, monkeypatch, tmp_path):
    """Near duplicates: a set travels in under 4 bytes a shingle, and shingles that link no two groups leave at once."""
    written = []
    inner = jaccard.stage_table
    monkeypatch.setattr(jaccard, "stage_table", lambda df, name: written.append((name, inner(df, name))) or written[-1][1])
    draw = np.random.default_rng(9)
    rows = []
    for i in range(60):  # two texts each: 50 exact copies, 10 near ones
        words = [f"w{x}" for x in draw.integers(0, 10**6, 200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words if i < 50 else ["other", *words[1:]]))]
    for side in (rows[::2], rows[1::2]):  # copies in two files, so that they meet in no block
        spark.createDataFrame(side, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    found = jaccard.similar_sets(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in found)
    sets = dict(written)["sets"].where("tokens is not null")
    assert sets.select(F.max(F.octet_length("tokens") / F.col("shared"))).first()[0] < 4
    first, *later = [df for name, df in written if name in ("postings", "open")]
    assert first.select("g").distinct().count() >= 60
    assert later and all(df.where("g < 100").isEmpty() for df in later)


def test_members_of_one_group_are_compared(spark, monkeypatch, tmp_path):
    """Sets with equal prefixes, of which the head is like no other, and no second group."""
    monkeypatch.setattr(jaccard, "SHINGLE", 1)
    p, x, y = ([f"{k}{i}" for i in range(n)] for k, n in (("p", 30), ("x", 80), ("y", 80)))
    rows = [(1, p + x), (2, p + y), (3, p + y[1:] + x[:1])]
    rows += [(10 + i, w + [f"u{i}.{k}" for k in range(200)]) for i, w in enumerate([x] * 4 + [y] * 4)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    found = jaccard.similar_sets(spark.read.parquet(f"{tmp_path}/docs")).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert got == {i: 2 if i == 3 else i for i, _ in rows}
