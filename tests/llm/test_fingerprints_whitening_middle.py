"""Multiset fingerprints, exact whitening and fill-in-middle, held to brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle, multiset_hash, queries, whitening

MARKS = ("<P>", "<S>", "<M>")


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    """The odd documents, with marks and line ends, and vectors, as the tables that queries read."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark = documents.sparkSession
    more = [(100 + i, t, None, "s", 0, "clash") for i, t in enumerate(["a <P> b\nc", "\n\n\n", "x\n", "one\r\ntwo\n\nthree", "<S", "<\n<\nP>\nS>\n<M\n>", "é\n😀\nü"])]
    documents.unionByName(spark.createDataFrame(more, documents.schema)).withColumn("n", F.lit("mine")).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(rng.normal(size=(300, 12)).astype(np.float32) @ np.diag(np.linspace(0.2, 3, 12)))]
    rows += [(300, None, "c"), (301, [None] * 12, "c"), (302, [float("nan")] + [0.0] * 11, "c"), (303, [float("inf")] * 12, "c"), (304, [1.0] * 11, "c"), (305, [], "c"), (306, [1e30] * 12, "c"), rows[5], (None, [0.5] * 12, "c")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    """Units, draws and form by the contract's words."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in MARKS):
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_is_the_contract(spark, folder):
    got = sorted(map(tuple, queries.op13_fill_middle(spark, folder).collect()), key=repr)
    want = []
    for doc_id, text in texts(spark, folder):
        n, form, p, m, out = cut(doc_id, text)
        want.append((doc_id, n, form, p, m, sha(out), sha(text)))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_hands_columns_on_and_takes_rates(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n", "kept", 7) for i in range(200)], "doc_id long, text string, other string, form int")
    out = fill_middle.transform(df, rate=50, suffix_first=0)
    assert out.columns == ["doc_id", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    forms = [r["form"] for r in out.collect()]
    assert set(forms) == {"plain", "psm"} and 60 < forms.count("plain") < 140
    assert fill_middle.transform(df.where("false")).count() == 0


def test_marks_at_a_cut_do_not_mislead_restoring(spark):
    """Texts that end or begin with parts of marks: the first whole mark is always the one that was put in."""
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["<", "<P", "S>", ">", "M", "<<", ""]) for _ in range(rng.randint(1, 6)))) for i in range(400)]
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = {r["doc_id"]: r["t"] for r in out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert back == dict(rows)


def fingerprint(text):
    return multiset_hash.written(*multiset_hash.sums(1, [(0, 1, p) for p in multiset_hash.paragraphs(text)]))[0]


def plain_fingerprint(text):
    """The definition, gram by gram."""
    exact, shape = [0] * multiset_hash.EXACT, [0] * multiset_hash.SHAPE
    for p in text.encode().split(b"\n") if text else []:
        wide = hashlib.shake_256(p).digest(8 * multiset_hash.EXACT)
        for k in range(multiset_hash.EXACT):
            exact[k] = (exact[k] + int.from_bytes(wide[8 * k : 8 * k + 8], "little")) % 2**64
        g = next(g for below, g in multiset_hash.GRAMS if len(p) < below)
        for gram in [p[i : i + g] for i in range(len(p) - g + 1)] if len(p) >= g else [p]:
            h = 0
            for c in gram:
                h = (h * int(multiset_hash.BASE) + c + 1) % 2**64
            key = int(multiset_hash.mix(np.array([h], np.uint64), g if len(p) >= g else 1)[0])
            shape[key >> 56] += 1 if key & 1 else -1
    return multiset_hash.written(np.array([exact], np.uint64), np.array([shape], np.int64))[0]


def test_fingerprint_is_its_definition_in_slices_too(monkeypatch, documents):
    some = [r["text"] or "" for r in documents.collect()]
    whole = [fingerprint(t) for t in some]
    assert whole == [plain_fingerprint(t) for t in some]
    monkeypatch.setattr(multiset_hash, "CHUNK", 40)
    assert [fingerprint(t) for t in some] == whole


def test_order_does_not_count_and_editing_is_adding_and_subtracting():
    a, b, c = "first paragraph of some words", "second", "third one, longer than the others by far and away"
    assert fingerprint("\n".join([a, b, c])) == fingerprint("\n".join([c, a, b])) != fingerprint("\n".join([a, b]))
    assert fingerprint("\n".join([a, a])) != fingerprint(a)
    assert multiset_hash.changed(fingerprint("\n".join([a, b, c])), deleted=[b.encode()], inserted=[b"new", b"new"]) == fingerprint("\n".join(["new", a, "new", c]))
    assert multiset_hash.changed(fingerprint(a), deleted=[a.encode()]) == fingerprint("")


def likeness(a, b):
    x, y = multiset_hash.parts_of(fingerprint(a)), multiset_hash.parts_of(fingerprint(b))
    return float(multiset_hash.likeness(x[0][None], x[1][None].astype(np.int64), y[0][None], y[1][None].astype(np.int64))[0])


def test_likeness_tells_shares():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [" ".join(word() for _ in range(40)) for _ in range(40)]
    for kept in (40, 30, 20, 10, 0):
        other = base[:kept] + [" ".join(word() for _ in range(40)) for _ in range(40 - kept)]
        assert abs(likeness("\n".join(base), "\n".join(other)) - kept / 40) < 0.2
    assert likeness("", "") == 1 and likeness("", "text") == 0 and likeness("\n", "\n") == 1
    assert likeness("\n".join(base), "\n".join(base[:30] + ["Des. " * 500])) > 0.5


def test_query_against_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(multiset_hash, "TASK_ROWS", 8)
    rows = {tuple(r) for r in queries.op11_multiset_hash(spark, folder).collect()}
    number = queries.op11_multiset_hash(spark, folder).count()
    docs = texts(spark, folder)
    assert number == len(docs)
    key = {(d, t): h for d, t, h in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0, key[r]))
    want = set()
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want.add((d, len(t), sha(e), fingerprint(t), fingerprint(e), likeness(t, e), likeness(t, following)))
    assert {r[:5] for r in rows} == {w[:5] for w in want}
    near = {r[:5]: r[5:] for r in rows}
    assert all(np.allclose(near[w[:5]], w[5:]) for w in want)


def test_one_document_follows_itself_and_copies_are_one(spark, empty):
    one = spark.createDataFrame([(4, "abcdefgh", 1)] * 5, "doc_id long, text string, near_next int")
    rows = multiset_hash.with_next(one).collect()
    assert len(rows) == 5 and {(r["edited"], r["near_next"]) for r in rows} == {("abcdefab", 1.0)}
    assert multiset_hash.with_next(empty).count() == 0 and multiset_hash.fingerprints(empty).count() == 0
    assert {r["fingerprint"] for r in multiset_hash.fingerprints(one).collect()} == {fingerprint("abcdefgh")}


def test_scatter_is_exact_for_any_long():
    rng = np.random.default_rng(5)
    for bits in (10, 30, 50, 62):
        x = rng.integers(-(2**bits), 2**bits, (9000 if bits < 40 else 40, 5))
        sums, cross = whitening.scatter(x)
        o = x.astype(object)
        assert (sums == o.sum(0)).all() and (cross == o.T @ o).all()


def test_whitening_against_numpy(spark, folder):
    out = queries.op12_whitening(spark, folder).toPandas()
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] and len(r["embedding"]) == 12 and all(v is not None and np.isfinite(v) and abs(v) < 1e15 for v in r["embedding"])]
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    assert n == 302 and len(out) == 8 * n and set(out["n"]) == {n}
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = (x - s / n) @ u[:, :8] / np.sqrt(e[:8])
    want = {}
    for (i, _), d, w in zip(kept, ((n * x - s) ** 2).sum(1).tolist(), z):
        want.setdefault(i, (d, w))
    got = out.drop_duplicates(["vec_id", "component"]).set_index(["vec_id", "component"])
    sign = {j: np.sign(got.loc[(0, j)]["whitened"] * want[0][1][j - 1]) for j in range(1, 9)}
    for (i, j), r in got.iterrows():
        d, w = want[None if np.isnan(i) else int(i)]
        assert r["deviation"] == d and abs(r["whitened"] * sign[j] - w[j - 1]) < 1e-8
        assert abs(r["explained"] / (e[j - 1] / e.sum()) - 1) < 1e-9
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9


def test_the_shift_does_not_matter(spark, folder):
    rows, d = whitening.usable(spark.read.parquet(f"{folder}/embeddings.parquet"))
    a, b = whitening.fit(rows, d, shift=0), whitening.fit(rows, d, shift=123_456)
    assert a.n == b.n and a.sums == b.sums and (a.values == b.values).all() and (a.vectors == b.vectors).all()
    with pytest.raises(ValueError):
        whitening.fit(rows, d, shift=-1)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, n string"
    none = spark.createDataFrame([(1, None, "x"), (2, [float("nan")], "x"), (3, [], "x")], schema)
    assert whitening.components_of(none).count() == 0 and whitening.components_of(none.where("false")).count() == 0
    flat = spark.createDataFrame([(i, [1.0, float(i % 2)], "x") for i in range(6)], schema)  # one dimension does not vary
    out = {(r["vec_id"], r["component"]): r for r in whitening.components_of(flat).collect()}
    assert len(out) == 12 and all(out[i, 2]["whitened"] is None and abs(abs(out[i, 1]["whitened"]) - 1) < 1e-12 for i in range(6))
    assert out[0, 1]["identity_error"] < 1e-12 and int(out[0, 1]["deviation"]) == (6 * 512) ** 2
    large = spark.createDataFrame([(i, [1e12 * (-1) ** i, 3.0], "x") for i in range(4)], schema)  # squares beyond a long
    assert int(whitening.components_of(large).first()["deviation"]) == (4 * 1024 * 10**12) ** 2
