"""The corpus pipeline's stages, each on what the one before kept, against brute force on a small fixture."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("weft.llm")
import corpus_pipeline as cp  # noqa: E402
from test_contracts import brute_classes, words  # noqa: E402
from weft.llm import mixing, ppm_langid, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    speech = {"en": "the of and to in that is was for with as on be at by this had not are but".split(), "de": "der die und das nicht mit auf ein ist dem von sich des auch als nach wie wird".split()}
    def text(lang, n):
        return " ".join(rng.choice(speech[lang]) + rng.choice(["", "", "ing" if lang == "en" else "ung"]) for _ in range(n))
    rows = [(i, text(k := ["en", "de"][i % 2], rng.randint(20, 90)), k, f"s{i % 3}", 0) for i in range(60)]
    base = text("en", 120).split()
    rows += [(100, " ".join(base), "en", "s0", 0), (101, " ".join(base[:-2] + ["other", "end"]), "en", "s1", 0), (102, " ".join(["new"] + base), "en", "s2", 0), (103, "  ".join(base), "en", "s0", 0)]
    rows += [(110, rows[5][1], "de", None, 0), (111, rows[5][1] + "\n", None, "s1", 0), (5, "a new text under an id that was there before and is still told apart from the other one", "en", "s1", 0)]
    rows += [(120, None, "en", "s0", 0), (121, "", None, "s0", 0), (122, "12 34 !!", "en", "s1", 0), (123, rows[7][1], "de", "s2", 0), (123, rows[7][1], "de", "s2", 0), (None, rows[9][1], "de", "s0", 0), (None, text("en", 30), "en", "s0", None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = queries.table(spark, folder, "documents")
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def stage(i, before):
        out = cp.STAGES[i][1](spark, before, folder)
        out.write.parquet(str(tmp_path / str(i)))
        return spark.read.parquet(str(tmp_path / str(i)))

    # Language: each text judged by itself on the driver, with a model from the same folds.
    one = stage(0, docs)
    assert one.columns == cp.COLUMNS
    learned = {}
    for r in docs.collect():
        if r.lang and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            learned.setdefault(r.lang, []).append(r.text)
    m = ppm_langid.train(learned)

    def accepted(t):
        import numpy as np
        if not t or not any(c.isalpha() for c in t):
            return False
        raw = np.frombuffer(t.encode(), np.uint8)
        at = np.array([0, len(raw)])
        return ppm_langid.posterior(ppm_langid.code_lengths(m, raw, at), np.diff(at)).max() >= ppm_langid.MIN_SCORE
    want = Counter((r.doc_id, r.text) for r in docs.collect() if accepted(r.text))
    assert kept(one) == want and sum(want.values()) >= 68

    # Exact copies: of equal normalised texts the smallest id, null last; one of rows that repeat it.
    two = stage(1, one)
    best = {}
    for i, t in want:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        best[key] = min(best.get(key, (True, float("inf"), "")), (i is None, i or 0, t))
    assert kept(two) == Counter((None if none else i, t) for none, i, t in best.values())

    # Near copies: classes of all pairs, by row since ids repeat.
    three = stage(2, two)
    rows = sorted(kept(two), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    classes = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    assert kept(three) == Counter(rows[k] for k in set(classes.values())) and len(set(classes.values())) < len(rows)

    # Mix: every document as often as the mix takes it.
    four = stage(3, three)
    taken = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix(three).collect() if r.size}
    assert kept(four) == Counter({(r.doc_id, r.text): n for r in three.collect() if (n := taken[(r.doc_id, len(words(r.text)))])})

    # Packing: every copy's tokens in gapless pieces.
    five = stage(4, four).toPandas()
    assert five.groupby("sequence_id")["length"].sum().max() <= 2048
    pieces = five.groupby(five["doc_id"].fillna(-1))["length"].sum()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = Counter()
    for (i, t), n in kept(four).items():
        ids[-1 if i is None else i] += n * (len(tok.encode(t, add_special_tokens=False).ids) + 1)
    assert {int(k): int(v) for k, v in pieces.items()} == dict(ids)


def test_stages_take_empty_tables(spark, folder):
    none = queries.table(spark, folder, "documents").where("false")
    for name, f in cp.STAGES:
        out = f(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == cp.COLUMNS)
