"""Token files, classifiers and the pipeline."""

import gc
import weakref
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowspark.llm import queries, quality_net, shingle_sets, token_files, toxicity_fm
from flowspark.llm.common import fresh_dir
from flowspark.llm.toxicity_fm import Machine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_encode_as_the_whole(tokenizer):
    texts = ["a  b", "a   b", "  x", " x", "x ", "x  ", "a\n\nb", "a \n b", "a\x1cb", "\x1c", "a  b", "a  b", "don't  I'm", "a.\n bar", "\n", "", None, "x y z", "q\t\tq", "a\u0085b c", "<|endoftext|> a", "<|endoftext|>", "x <|endoftext|>y  z", "<|endof text|>", "a \0b", "a\0 b"]
    encoder = token_files.Encoder(queries.tokenizer_path())
    for part in (texts, texts[::-1], ["again a b"] * 2):
        ids, sizes = encoder.encode(part, 2)
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_many_to_a_text(tokenizer):
    encoder = token_files.Encoder(queries.tokenizer_path())
    counting = encoder.tokenizer = Counting(encoder.tokenizer)
    words = [f"wörd{k}x's,\nNo" for k in range(3000)]
    texts = ["a " + " ".join(words[:2000]), "b  c", None, "a " + " ".join(words[1000:]) + " ", "", "\u3000\u3000a b"]
    ids, sizes = encoder.encode(texts, 2)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert counting.texts < 100
    again = counting.texts
    assert encoder.encode(texts, 2)[0].tolist() == ids.tolist() and counting.texts == again
    assert encoder.encode([], 2)[0].tolist() == []


def test_odd_texts_keep_their_places(tokenizer):
    spaces = [chr(k) for k in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0xFEFF, 0]]
    texts = [f"{a}{b}x {a}y{b} z{b}{a}" for a in spaces for b in ("", *spaces)]
    encoder = token_files.Encoder(queries.tokenizer_path())
    ids, sizes = encoder.encode(texts, 2)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("blanks", [True, False])
def test_words_of_other_tokenizers(tmp_path, blanks):
    from tokenizers import Tokenizer, models, pre_tokenizers

    if blanks:  # words that stand side by side in a text of words must not become an added token
        other = Tokenizer.from_file(queries.tokenizer_path())
        other.add_tokens(["x y", "-#\n&", "a b.c"])
    else:  # no token holds the blank before it
        other = Tokenizer(models.WordLevel({"x": 0, "y": 1, "q": 2, "?": 3}, unk_token="?"))
        other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(path := str(tmp_path / "tokenizer.json"))
    texts = ["q x", "q y", "y q", "x y", "q x yq", "a a b.c", "a a bxc", "q -#\n& q", "q x q y", "q  y"]
    ids, sizes = token_files.Encoder(path).encode(texts, 9)
    want = [[*other.encode(t, add_special_tokens=False).ids, 9] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_are_dropped_when_a_worker_turns_to_other_work():
    path = queries.tokenizer_path()
    kept = weakref.ref(token_files.encoder(path))
    assert token_files.encoder(path) is kept()  # from task to task
    list(shingle_sets._sets(pa.array(["a b c"]), 5))
    gc.collect()
    assert kept() is None


def test_token_files(spark, docs, doc_rows, no_docs, tokenizer):
    path = fresh_dir(spark, "test-tokens")
    got = token_files.token_table(docs, path, tokenizer=queries.tokenizer_path(), end_id=2).orderBy("start").collect()
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in sorted(doc_rows, key=lambda r: (r[0] is not None, r[0]))]
    at = np.concatenate([[0], np.cumsum([len(i) for _, i in ids])])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, i), s in zip(ids, at.tolist())]
    one = token_files.read_tokens(spark, path, [9]).collect()
    assert [(r.doc_id, list(r.tokens)) for r in one] == [(d, i) for d, i in ids if d == 9]
    plan = token_files.read_tokens(spark, path, [9]).select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,9)" in plan.split("PushedFilters")[-1] and "tokens:array" not in plan.split("ReadSchema")[-1]
    file = urlparse(spark.read.parquet(path).where("n_tokens > 100").inputFiles()[0]).path
    column = pq.ParquetFile(file).metadata.row_group(0)
    by_name = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in by_name["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in by_name.values())
    assert token_files.token_table(no_docs, fresh_dir(spark, "test-none"), tokenizer=queries.tokenizer_path(), end_id=2).count() == 0


@pytest.mark.parametrize("module", [quality_net, toxicity_fm])
def test_classifiers_on_odd_rows(spark, docs, doc_rows, no_docs, labels, module):
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    scores = module.classify(docs, labels, usable).collect()
    assert len(scores) == len(doc_rows) and all(0 <= r.score <= 1 for r in scores)
    again = module.classify(docs.repartition(5), labels, usable).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in scores) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)
    assert module.classify(no_docs, labels, usable).count() == 0
    assert {r.score for r in module.classify(docs, labels.limit(0), usable).collect()} == {0.5}
    assert {r.score for r in module.classify(docs, labels.where("quality = 1 AND toxic = 1"), usable).collect()} == {1.0}


@pytest.mark.parametrize("name, label, least", [("op4_quality_net", "quality", 0.97), ("op8_toxicity_fm", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_pairs_weigh_more_than_terms():
    """Neither word tells alone, both together do: only the pair term can learn that."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(["insult"] * a + ["group"] * b + [f"w{rng.integers(40)}"]), float(a and b)))
    import pyarrow as pa

    from flowspark.llm.bytetext import text_bytes

    machine = toxicity_fm.fit(*text_bytes(pa.array([t for t, _ in rows])), np.array([y for _, y in rows]))
    a, b, both = machine.scores(*text_bytes(pa.array(["insult w1", "group w1", "insult group w1"])))
    assert both > 0.7 > 0.5 > max(a, b)
    assert isinstance(machine, Machine) and np.abs(machine.factors).max() > 0.05


def test_words_that_are_neutral_alone_tell_in_a_pair():
    """Each word is as common in either class; which two stand together decides."""
    import pyarrow as pa

    from flowspark.llm.bytetext import text_bytes

    rng = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["insult" if a else "praise", "group" if b else "crowd", *[f"w{rng.integers(400)}" for _ in range(10)]]
        rows.append((" ".join(words), float(a == b)))
    texts, y = text_bytes(pa.array([t for t, _ in rows])), np.array([v for _, v in rows])
    scores = toxicity_fm.fit(texts[0], texts[1], y).scores(*texts)
    assert ((scores >= 0.5) == y).mean() > 0.98


def test_model_pair_sum_is_the_plain_one():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, rng.normal(size=6), rng.normal(size=(6, toxicity_fm.FACTORS)), 0.5)
    own = [0, 2, 5]
    plain = 0.3 + machine.weight[own].sum() + sum(machine.factors[i] @ machine.factors[j] for i in own for j in own if i < j)
    assert machine.logits(np.zeros(3, int), np.array(own), 1)[0] == pytest.approx(plain)


def test_temperature_calibrates():
    import pyarrow as pa

    from flowspark.llm.bytetext import text_bytes

    rng = np.random.default_rng(2)
    y = (rng.random(800) < 0.5).astype(float)
    noisy = np.where(rng.random(800) < 0.2, 1 - y, y)  # one label in five is wrong
    texts = [" ".join(("good" if v else "bad") + str(rng.integers(30)) for _ in range(8)) for v in y]
    scores = quality_net.fit(*text_bytes(pa.array(texts)), noisy).scores(*text_bytes(pa.array(texts)))
    assert abs(np.maximum(scores, 1 - scores).mean() - 0.8) < 0.12


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_d", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    columns = docs.columns
    left = docs.count()
    from flowspark.llm.common import materialized

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialized(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() <= left
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        left = docs.count()
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == left
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_sql_of_decontamination(spark):
    from oracle import compare, connect

    for name, sql in queries.ORACLE.items():
        assert compare(spark, connect(SF), name, queries.QUERIES[name], sql, SF) is None
