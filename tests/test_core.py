import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import align as A
from spanloom.operators import chain as C
from spanloom.operators import spans as S
from spanloom.operators import text as T
from spanloom.operators.periods import periods_and_gaps, prediction_periods
from spanloom.sources import notes as N
from spanloom.sources import sinks as K

TEXT = "Dr. John Smith, 03/14/10"


def brute(rows, max_gap):
    out = set()
    by = {}
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] <= max_gap}
    return out


@pytest.mark.parametrize("shard", [7, 64, 4096])
def test_periods_against_brute_force(spark, shard):
    r = random.Random(shard)
    rows = [(r.choice(["a", "b", None]), x := r.randint(-50, 900), x + r.choice([-3, 0, 1, 2, 5, 9, 300])) for _ in range(250)]
    rows += [("a", None, 3), ("a", 3, None), ("h", 0, 900), ("h", 900, 901), ("h", 100, 120)] + rows[:40]
    df = spark.createDataFrame(rows, "k string, start int, stop int")
    got = [tuple(x) for x in periods_and_gaps(df, ["k"], max_gap=30, shard=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 30)


def test_periods_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "document_id string, entity_type string, start int, stop int, kind string, _a int, _k0 string")
    assert prediction_periods(df).count() == 0
    df = spark.createDataFrame([(" txt/n1.txt ", "b-date ", 1, 5, "x", 1, "y"), ("n1", "DATE", 5, 9, None, None, None)], df.schema)
    assert [tuple(r) for r in prediction_periods(df).collect()] == [("n1", "DATE", "period", 1, 9)]


def test_tokens_and_word_punct(spark):
    df = spark.createDataFrame([("d", TEXT), ("e", None), ("f", "")], "document_id string, text string")
    t = [(r.entity, r.start, r.stop) for r in T.pattern_spans(df, ["document_id"], {"T": T.TOKEN}).collect()]
    assert t == [("Dr.", 0, 3), ("John", 4, 8), ("Smith,", 9, 15), ("03/14/10", 16, 24)]
    w = [r.entity for r in T.pattern_spans(df, ["document_id"], {"T": T.WORD_PUNCT}).collect()]
    assert w == ["Dr", ".", "John", "Smith", ",", "03", "/", "14", "/", "10"]


def test_typed_merge_union_bio(spark):
    x = spark.createDataFrame([("d", "X", 0, 10), ("d", "X", 2, 5), ("d", "X", 6, 7), ("d", "X", 20, 25)], "document_id string, entity_type string, start int, stop int")
    assert sorted((r.start, r.stop) for r in S.merge_typed(x, ["document_id", "entity_type"]).collect()) == [(0, 5), (6, 7), (20, 25)]
    assert sorted((r.start, r.stop) for r in S.merge_union(x, ["document_id"]).collect()) == [(0, 10), (20, 25)]
    g = spark.createDataFrame([("d", "NAME", 4, 14), ("d", "DATE", 16, 24)], x.schema)
    words = T.pattern_spans(spark.createDataFrame([("d", TEXT)], "document_id string, text string"), ["document_id"], {"T": T.WORD_PUNCT})
    bio = S.bio_split(g, words)
    assert sorted((r.start, r.label) for r in bio.collect()) == [(4, "B-NAME"), (9, "I-NAME"), (16, "B-DATE"), (18, "I-DATE"), (19, "I-DATE"), (21, "I-DATE"), (22, "I-DATE")]
    assert sorted((r.start, r.stop, r.entity_type) for r in S.bio_merge(bio).collect()) == [(4, 14, "NAME"), (16, 24, "DATE")]


def test_coverage(spark):
    s = "document_id string, entity_type string, start int, stop int"
    gold = spark.createDataFrame([("d", "N", 4, 14), ("d", "D", 16, 24), ("e", "N", 0, 10), ("f", "N", 2, 4), ("g", "N", 2, 4)], s)
    pred = spark.createDataFrame([("d", "N", 9, 14), ("d", "D", 16, 18), ("d", "O", 0, 2), ("e", "N", 2, 4), ("f", "N", 0, 10)], s)
    got = {(r.document_id, r.start): (r.coverage, r.uncovered) for r in S.coverage(gold, pred).collect()}
    assert got == {("d", 4): ("partial", "4 9"), ("d", 16): ("partial", "18 24"), ("e", 0): ("partial", "0 2;4 10"), ("f", 2): ("exact", ""), ("g", 2): ("missed", "2 4")}


def test_redact_fold(spark):
    df = spark.createDataFrame([(TEXT, [(4, 8), (8, 9), (9, 14)])], "text string, s array<struct<start: int, stop: int>>")
    assert df.select(T.redact_spans(F.col("text"), F.col("s"))).first()[0] == "Dr. ___, 03/14/10"


def test_label_maps():
    assert [L.label_map("simple")[x] for x in ("DOCTOR", "CITY", "URL", "PHONE", "PROFESSION")] == ["NAME", "LOCATION", "LOCATION", "CONTACT", "PROFESSION"]
    assert [L.label_map("hipaa")[x] for x in ("DOCTOR", "CITY", "URL", "PHONE", "PROFESSION")] == ["O", "LOCATION", "LOCATION", "CONTACT", "O"]
    assert {L.label_map("binary")[x] for x in ("DOCTOR", "CITY", "PHI")} == {"PHI"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "txt").mkdir(), (tmp_path / "ann").mkdir()
    (tmp_path / "txt" / "n1.txt").write_text(TEXT)
    (tmp_path / "txt" / "n2.txt").write_text("nothing\nat all\n")
    (tmp_path / "ann" / "n1.gs").write_text('start,stop,entity,entity_type\n4,14,"John Smith",NAME\n')
    rows = {r.document_id: r for r in N.labelled_notes(spark, str(tmp_path)).collect()}
    assert rows["n1"].entity == "John Smith" and rows["n1"].length == 10 and rows["n2"].start is None
    assert rows["n2"].text == "nothing\nat all\n" and len(rows) == 2
    a = N.read_annotations(spark, str(tmp_path / "ann"))
    assert K.brat_lines(a).first().line == "T1\tNAME 4 14\tJohn Smith"
    K.write_annotations(K.with_annotation_ids(a), str(tmp_path / "out"))
    assert any("John Smith" in p.read_text() for p in Path(tmp_path / "out").glob("*.csv"))


def test_streaming_redaction(spark, tmp_path):
    from spanloom.streaming.redaction import redact_stream

    spark.createDataFrame([("a", "mail x@y.example now")], "guid string, text string").write.parquet(str(tmp_path / "in"))
    q = redact_stream(spark.readStream.schema("guid string, text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("red").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("red").first().redacted == "mail ___ now"


def _value(v):
    return round(v, 9) if isinstance(v, float) else v


def test_queries_match_sql(spark):
    """Every query of the core against its SQL, on whole tables."""
    import duckdb

    import __spark_entry__ as e
    from spanloom.plans import reference

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql, wrong = e.queries(), e.oracle_sql(), []
    for name in ["p4_found", *reference.QUERIES]:
        got = queries[name](spark, d)
        cols = sorted(got.columns)
        found = con.execute(sql[name])
        assert sorted(c[0] for c in found.description) == cols, name
        order = [[c[0] for c in found.description].index(c) for c in cols]
        want = [tuple(_value(r[i]) for i in order) for r in found.fetchall()]
        rows = [tuple(map(_value, r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
        if sorted(rows, key=repr) != sorted(want, key=repr):
            wrong.append(name)
    assert not wrong


def test_sources_read_each_file_by_its_header(spark, tmp_path):
    for model, files in {"m1": {"a.pred": "start,stop,entity,entity_type\n4,14,\"John, Smith\",NAME\n", "b.pred": "entity_type,offset,entity,length\nDATE,3,x,5\nDATE,?,y,5\n"}, "m2": {"c.pred": "document_id,annotation_id,start,stop,entity,entity_type,comment\nq,T1,1,2,z,ID,\n", "d.pred": ""}}.items():
        (tmp_path / model).mkdir()
        for name, text in files.items():
            (tmp_path / model / name).write_text(text)
    rows = sorted(tuple(r) for r in N.read_models(spark, str(tmp_path)).select("model_name", "document_id", "start", "stop", "entity", "entity_type").na.fill(-1).collect())
    assert rows == [("m1", "a", 4, 14, "John, Smith", "NAME"), ("m1", "b", -1, -1, "y", "DATE"), ("m1", "b", 3, 8, "x", "DATE"), ("m2", "q", 1, 2, "z", "ID")]
    n = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert {tuple(r) for r in N.complete_models(N.read_models(spark, str(tmp_path)), n).collect()} == {("m1", 0, 0), ("m2", 2, 1)}
    (tmp_path / "n.tsv").write_text("token\tlabel_id\tO\tNAME\nJohn\t1\t0.25\t0.75\n")
    r = N.csv_rows(spark, str(tmp_path / "n.tsv"), ".tsv", sep="\t").first()
    assert r.row["token"] == "John" and r.file_stem == "n"
    (tmp_path / "n.prob").write_text("token,label_id,O,NAME\nJohn,1,0.25,0.75\n")
    p = N.read_probabilities(spark, str(tmp_path / "n.prob")).first()
    assert p.probs == {"O": 0.25, "NAME": 0.75} and p.label_id == 1
    (tmp_path / "t.csv").write_text('row_id,text\n7,"two\nlines"\n')
    assert [tuple(x) for x in N.read_note_table(spark, str(tmp_path / "t.csv")).collect()] == [("7", "two\nlines")]
    with pytest.raises(TypeError):
        N.labels_from_rows(spark, [("d", "NAME", "4", 3, "x")])
    with pytest.raises(ValueError):
        N.labelled_notes(spark, str(tmp_path), "dve")
    assert N.labels_from_rows(spark, [("d", "NAME", 4, 3, "x")]).first().stop == 7
    made = []
    for _ in range(2):
        t = N.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3))
    assert t.count() == 3 and made == [1]


def test_sinks(spark, tmp_path):
    notes = spark.createDataFrame([("d", TEXT)], "document_id string, text string")
    g = spark.createDataFrame([("d", "NAME", 4, 14, None), ("d", "AGE > 89", 15, 20, "T7"), ("d", "O", 0, 2, None)], "document_id string, entity_type string, start int, stop int, annotation_id string")
    lines = {r.line for r in K.brat_lines(S.with_entity(g, notes)).collect()}
    assert lines == {"T7\tAGE_>_89 16 20\t03/1", "T8\tO 0 2\tDr", "T9\tNAME 4 14\tJohn Smith"}
    assert [(r.annotation_id, r.start) for r in K.with_annotation_ids(g).collect()] == [("2", 4), ("3", 15)]
    K.write_annotations(g, str(tmp_path / "ann"), per_document=True)
    assert next((tmp_path / "ann" / "document_id=d").glob("*.csv")).read_text().startswith("annotation_id,start,stop")
    K.write_metrics(spark.createDataFrame([("m", "r", 1)], "model_name string, record string, start int"), str(tmp_path / "cmp"), compared=True)
    assert list((tmp_path / "cmp").glob("*.csv.gz"))
    K.write_redacted_files(spark.createDataFrame([("d", "a\nb")], "document_id string, redacted string"), str(tmp_path / "red"))
    assert next((tmp_path / "red" / "document_id=d").glob("*.txt")).read_text().rstrip("\n") == "a\nb"
    runs = spark.createDataFrame([("d", 4, 8, "tp"), ("d", 8, 14, "fn")], "document_id string, start int, stop int, state string")
    assert K.coloured(runs, notes).first().shown == "Dr. \x1b[92mJohn\x1b[0m\x1b[91m_Smith\x1b[0m, 03/14/10"
    cover = spark.createDataFrame([("d", 4, 14, "partial", "4 6;9 14"), ("d", 0, 2, "exact", "")], "document_id string, start int, stop int, coverage string, uncovered string")
    assert [r.line for r in K.brat_coverage_lines(cover, notes).collect()] == ["T1\tPARTIAL 4 6;9 14\tJo Smith"]
    a = spark.createDataFrame([("d", 4, 8, None, "NAME", "b"), ("d", 1, 2, "ID", "ID", "same")], "document_id string, start int, stop int, type_a string, type_b string, verdict string")
    K.write_chosen(a, str(tmp_path / "chosen"))
    assert sum("ID" in p.read_text() for p in (tmp_path / "chosen").glob("*.csv")) == 1
    K.write_lines(K.evaluation_lines(spark.createDataFrame([(0.5, None, 1.0)], "se double, ppv double, f1 double")), str(tmp_path / "eval"))
    assert sorted(x for p in (tmp_path / "eval").glob("*.txt") for x in p.read_text().split("\n") if x) == ["f1 = 1.0", "ppv = null", "se = 0.5"]


def test_fold_of_overlapping_spans(spark):
    """A note with nested, touching, crossing and repeated spans against a plain fold from the right."""
    note = "".join(f"Line {i}: seen by Dr. Ann Lee on 0{i}/1{i}/10, born 19{i}0, record 10{i}44.\n" for i in range(1, 9))
    r = random.Random(2)
    spans = sorted({(a := r.randrange(len(note) - 12), a + r.randint(1, 12)) for _ in range(30)} | {(17, 20), (20, 21), (21, 24), (34, 36), (34, 42)})
    text, last = note, -1
    for a, b in reversed(spans):
        text = text[:a] + "___" + (text[b + 3 :] if b == last else text[b:])
        last = a
    df = spark.createDataFrame([(note, spans)], "text string, s array<struct<start: int, stop: int>>")
    assert df.select(T.redact_spans(F.col("text"), F.col("s"))).first()[0] == text


def test_typed_merge_over_shards(spark):
    r = random.Random(9)
    rows = [(r.choice(["a", None]), x := r.randint(0, 400), x + r.choice([1, 2, 5, 40])) for _ in range(200)]
    want = []
    for k in ("a", None):
        prev = None
        for a, b in sorted((a, b) for q, a, b in rows if q == k):
            if prev is None or a - 1 > prev:
                want.append([k, a, b, 0])
            want[-1][2:] = [b, want[-1][3] + 1]
            prev = b
    df = spark.createDataFrame(rows, "k string, start int, stop int")
    got = [[x.k, x.start, x.stop, x.n_spans] for x in S.merge_typed(df, ["k"], 1, shard=32).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    x = spark.createDataFrame([("d", "N", 4, 8, "John"), ("d", "N", 9, 14, "Smith"), ("d", "N", 20, 21, "x")], "document_id string, entity_type string, start int, stop int, entity string")
    assert sorted((r.start, r.stop, r.entity) for r in S.merged_entity(x, ["document_id", "entity_type"], 1).collect()) == [(4, 14, "John?Smith"), (20, 21, "x")]


def test_token_parts_and_modes(spark):
    """Ids none, none, 3, 3, 1 in one token: cut where they rise, not where they fall."""
    s = "document_id string, entity_type string, start int, stop int"
    tokens = spark.createDataFrame([("d", 0, 5), ("d", 6, 8)], "document_id string, start int, stop int")
    chars = A.char_labels(spark.createDataFrame([("d", "3", 2, 4), ("d", "1", 4, 5)], s))
    assert sorted((r.start, r.stop) for r in A.token_parts(tokens, chars, F.col("label")).collect()) == [(0, 2), (2, 5)]
    got = {(r.start, r.stop): (r.truth, r.pred) for r in A.aligned_tokens(tokens, chars, A.char_labels(spark.createDataFrame([("d", "9", 3, 4), ("d", "7", 6, 8), ("d", "7", 6, 8)], s)), F.col("label")).collect()}
    assert got == {(2, 5): ("3", "9"), (6, 8): (None, "7")}
    late = A.lower_bound_tokens(spark.createDataFrame([("d", "X", 1, 7), ("d", "Y", 7, 9)], s), tokens)
    assert sorted((r.entity_type, r.start) for r in late.collect()) == [("X", 6), ("Y", 6)]
    none = tokens.limit(0)
    assert A.token_parts(none, chars, F.col("label")).count() == 0 and A.context_of_tokens(spark.createDataFrame([], s), none.withColumn("pos", F.lit(1)).withColumn("entity", F.lit(""))).count() == 0


def test_chain_against_enumeration(spark):
    import itertools
    import math

    r = random.Random(4)
    n, t = 3, [[r.uniform(-1, 1) for _ in range(3)] for _ in range(3)]
    st, en = [r.uniform(-1, 1) for _ in range(3)], [r.uniform(-1, 1) for _ in range(3)]
    rows = [([[r.uniform(-1, 1) for _ in range(n)] for _ in range(k)], [r.randrange(n) for _ in range(k)]) for k in (1, 2, 4)] + [([], []), (None, None)]
    df = spark.createDataFrame(rows, "e array<array<double>>, y array<int>")
    got = df.select(C.viterbi(F.col("e"), t, st, en).alias("v"), C.log_likelihood(F.col("e"), F.col("y"), t, st, en).alias("l"), F.size("e").alias("k")).collect()
    for (e, y), x in zip(rows, got):
        if not e:
            assert x.v is None and x.l is None
            continue
        score = {p: st[p[0]] + en[p[-1]] + sum(e[i][k] for i, k in enumerate(p)) + sum(t[a][b] for a, b in zip(p, p[1:])) for p in itertools.product(range(n), repeat=len(e))}
        best = max(score, key=score.get)
        assert tuple(x.v.path) == best and abs(x.v.score - score[best]) < 1e-9
        assert abs(x.l - (score[tuple(y)] - math.log(sum(map(math.exp, score.values()))))) < 1e-9
    flat = df.select(C.log_likelihood(F.col("e"), F.col("y"), t, st, en).alias("l"), F.size("e").alias("k")).where("k > 0")
    total, mean, per = (C.reduced(flat, "l", "k", h).first()[0] for h in ("sum", "mean", "token_mean"))
    assert abs(total / 3 - mean) < 1e-9 and abs(total / 7 - per) < 1e-9
    with pytest.raises(ValueError):
        C.viterbi(F.col("e"), t, st[:2], en)


def test_state_runs(spark):
    r = random.Random(5)
    sides = [[(d, a := r.randint(0, 90), a + r.randint(1, 12)) for d in ("a", "b", "c") for _ in range(r.randint(3, 9))] for _ in range(2)]
    sides[0].append(("g", 1, 4))
    sides[1].append(("p", 2, 5))
    chars = [{(d, i) for d, a, b in x for i in range(a, b)} for x in sides]
    want = set()
    for state, x in (("tp", chars[0] & chars[1]), ("fn", chars[0] - chars[1]), ("fp", chars[1] - chars[0])):
        for d, i in x:
            if (d, i - 1) not in x:
                stop = i
                while (d, stop) in x:
                    stop += 1
                want.add((d, i, stop, state))
    got = S.state_runs(*[spark.createDataFrame(x, "document_id string, start int, stop int") for x in sides]).select("document_id", "start", "stop", "state").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_command_line(spark, tmp_path, capsys):
    from spanloom.__main__ import main

    for sub, name, text in (("txt", "n1.txt", TEXT), ("txt", "n2.txt", "mail a@b.test now"), ("ann", "n1.gs", "start,stop,entity,entity_type\n4,14,John Smith,NAME\n"), ("pred", "n1.pred", "start,stop,entity,entity_type\n9,14,Smith,NAME\n16,24,03/14/10,DATE\n")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / name).write_text(text)
    at = {k: str(tmp_path / k) for k in ("txt", "ann", "pred", "out", "cmp", "com")}
    assert main(["redact", "--text", "mail a@b.test now", "--repl", "#"], spark) == 0 and capsys.readouterr().out == "mail # now\n"
    assert main(["redact", "--text_dir", at["txt"], "--pred_dir", at["pred"]], spark) == 0
    assert capsys.readouterr().out == "Dr. John ___, ___\nmail a@b.test now\n"
    assert main(["evaluate", "--text_dir", at["txt"], "--gold_dir", at["ann"], "--pred_dir", at["pred"], "--out", at["out"]], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["se = 0.5", "ppv = 0.5"]
    assert main(["compare", "--text_dir", at["txt"], "--gold_dir", at["ann"], "--pred_dir", at["pred"], "--out", at["cmp"]], spark) == 0
    assert main(["combine", "--text_dir", at["txt"], "--pred_dir", at["pred"], "--out", at["com"]], spark) == 0
    assert any("a@b.test" in p.read_text() for p in (tmp_path / "com").glob("*.csv"))
    with pytest.raises(SystemExit):
        main(["redact", "--text", "a", "--text_dir", "b"], spark)


def test_annotators(spark):
    from spanloom.operators import annotators as X

    notes = spark.createDataFrame([("d", "mail a@b.test"), ("e", None), ("f", "")], "document_id string, text string")
    load = lambda: lambda texts: [[(0.9, "NAME", 0, 4), (0.8, "O", 1, 2), (0.7, "ID", 90, 3), (0.6, "ID", 0, 0)] if t else [] for t in texts]
    got = [tuple(r) for r in X.model_annotator(load, 2)(notes).collect()]
    assert got == [("d", 0, 4, "NAME", "mail", 0.9)]
    X.ANNOTATORS.pop("own", None)
    X.register("own", X.model_annotator(load))
    assert {tuple(r) for r in X.annotate(notes, "own", "email").select("start", "annotator").collect()} == {(0, "own"), (5, "email")}
    assert X.annotate(notes).count() == 2
    with pytest.raises(ValueError):
        X.register("own", X.ANNOTATORS["email"])
    with pytest.raises(ValueError):
        X.annotate(notes, "none")
    X.ANNOTATORS.pop("own")


def test_tokenizers(spark):
    df = spark.createDataFrame([("d", "a  b \tü1")], "document_id string, text string")
    got = {h: [(r.start, r.stop, r.entity) for r in T.tokenized(df, h).orderBy("pos").collect()] for h in ("split", "space", "char", "word")}
    assert got["split"] == [(0, 1, "a"), (1, 1, ""), (3, 4, "b"), (4, 4, ""), (6, 8, "ü1")]
    assert got["space"] == got["word"] == [(0, 1, "a"), (3, 4, "b"), (6, 8, "ü1")] and got["char"][-1] == (7, 8, "1")
    with pytest.raises(ValueError):
        T.tokenized(df, "none")
    assert K.token_lines(T.tokenized(df, "space")).first().line == "0\t0\t1\ta"


def test_combined_repeats_the_models_spans_per_feature(spark):
    from spanloom.operators import predictions as P

    m = spark.createDataFrame([("d", "ID", 0, 4), ("d", "LOCATION", 9, 12), ("d", "X", 1, 2), ("d", "X", 1, 2)], "document_id string, label string, start int, stop int")
    r = spark.createDataFrame([("d", "mrn", 4, 6), ("d", "ssn", 8, 9), ("d", "none", 1, 2)], "document_id string, feature string, start int, stop int")
    got = {tuple(x) for x in P.combined(m, r).select("feature", "label", "start", "stop").collect()}
    ids = {(f, "ID", 0, 4) for f in ("idnum", "pager", "ssn", "unit")}
    assert got == ids | {("mrn", "ID", 0, 6), ("ssn", "ID", 8, 9), ("location", "LOCATION", 9, 12), (None, "X", 1, 2)}
    assert P.combined(m.limit(0), r.limit(0)).count() == 0


def test_standoff_edges(spark):
    """The last window holds, also where it says none; special and unscored sub-words make no prediction."""
    from spanloom.operators import predictions as P

    s = "document_id string, segment int, start int, stop int, word_length int, is_sub boolean, special boolean, logits array<double>"
    rows = [("d", 0, 0, 4, 7, False, False, [0.0, 2.0]), ("d", 1, 0, 4, 7, False, False, [3.0, 2.0]), ("d", 0, 4, 7, 3, True, False, [0.0, 0.0]), ("d", 0, 9, 9, 0, False, True, [0.0, 9.0]), ("d", 0, 10, 12, 5, False, False, [0.0, 1.0]), ("d", 0, 12, 15, 3, True, False, [0.0, 1.0]), ("d", 0, 20, 21, 1, False, False, None)]
    got = sorted((r.start, r.length, r.label, round(r.prob, 6)) for r in P.standoff(spark.createDataFrame(rows, s), ["O", "ID"]).collect())
    assert got == [(10, 5, "ID", 0.731059), (12, 3, "ID", 0.731059)]
    assert P.standoff(spark.createDataFrame([], s), ["O", "ID"]).count() == 0


def test_running_sums_and_noise_edges(spark):
    from spanloom.operators import predictions as P

    r = random.Random(8)
    rows = sorted({round(r.random(), 3) for _ in range(400)})
    df = spark.createDataFrame([(x, 1, i) for i, x in enumerate(rows)], "score double, a int, b int")
    got = {x.score: (x.a, x.b, x.all_a) for x in P.running_by_score(df, "score", ["a", "b"], buckets=16).collect()}
    assert got == {x: (len(rows) - i, sum(range(i, len(rows))), len(rows)) for i, x in enumerate(rows)}
    assert P.running_by_score(df.limit(0), "score", ["a"]).count() == 0
    p = spark.createDataFrame([(i, 0, [0.9, 0.1]) for i in range(6)] + [(10 + i, 1, [0.2, 0.8]) for i in range(6)] + [(20, 0, [0.05, 0.95]), (21, 2, [0.5, 0.5])], "id int, y int, p array<double>")
    assert [(x.id, x.suggested) for x in P.noise_ranking(p, "id", "y", "p").collect()] == [(20, 1)]
    assert P.noise_ranking(p.limit(0), "id", "y", "p").count() == 0


def test_flagged_tokens(spark):
    """Tokens looked up in sorted lists against tokens joined in blocks, with spans that touch, nest, repeat and reach out."""
    r = random.Random(12)
    notes = [(k, " ".join("x" * r.randint(1, 9) for _ in range(r.randint(0, 120)))) for k in "abcd"] + [("e", None), ("f", "  y\n")]
    spans = lambda n: [(r.choice("abcdg"), a := r.randint(-5, 700), a + r.randint(1, 40)) for _ in range(n)] + [("f", 2, 3)]
    df = spark.createDataFrame(notes, "document_id string, text string")
    g, p = (spark.createDataFrame(spans(n), "document_id string, start int, stop int") for n in (20, 30))
    tokens = T.pattern_spans(df, ["document_id"], {"T": T.TOKEN})
    cols = ["document_id", "start", "stop", "entity", "in_gold", "in_pred"]
    one = S.flagged_tokens(df, g, p)
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, S.token_flags(tokens, g, p).select(cols).collect()))
    assert one.where("document_id = 'f'").first().n_split == 4 and one.where("in_gold").count() > 5
    assert S.flagged_tokens(df, g.limit(0), p).count() == 0 and S.flagged_tokens(df, g, p.limit(0)).where("in_pred").count() == 0


def _exchanges(df):
    return sum(re.match(r"[\s:+*|-]*(\(\d+\) )?(Exchange|BroadcastExchange)\b", x) is not None for x in df._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.fixture(scope="module")
def odd_spans(spark, tmp_path_factory):
    """Notes and spans with nulls, empty labels and models, ends outside the text, nested and repeated spans."""
    r, d = random.Random(7), str(tmp_path_factory.mktemp("odd"))
    words = ["Dr.", "Smith", "ab-cd", "x", "😀y", "Zoë", "03/14/10", "a_b", "...", "\n", "  ", "I"]
    notes = [(None, "no id"), ("n4", None), ("n5", ""), ("n6", " \n ")] + [(f"n{i}", " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for i in [*range(24), 0, 7]]
    label = lambda: r.choice(["NAME", "DATE", "B-NAME", "i-id", " ", "ZZ", None, "b-"])
    span = lambda k: (k, a := r.randint(-3, 60), a + r.choice([0, -1, 1, 2, 3, 5, 8, 40]), label())
    gold = [span(r.choice([f"n{i}", f" txt/n{i}.txt "])) for i in range(24) if i % 5 != 1 for _ in range(9)] + [(None, 0, 4, "NAME"), ("n8", None, 4, "DATE"), ("n8", 2, None, "DATE")]
    pred = [(*span(r.choice([f"n{i}", f"a\\n{i}.pred"])), r.choice(["m1", "m2", None, "m3"])) for i in range(24) for _ in range(14)] + [("zz", 0, 9, "Q", "m4"), ("n2", None, 3, "Q", "m5")]
    s = "document_id string, start int, stop int, entity_type string"
    for name, rows, schema in (("input_examples", notes, "guid string, text string"), ("gold_annotations", gold + gold[:20], s), ("predictions", pred + pred[:40], s + ", model_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


#: Queries on token labels and the exchanges that their plans may have.
TOKEN_QUERIES = {
    "comparison_by_model": 12,
    "label_token_counts": 12,
    "missed_tokens_per_document": 12,
    "token_accuracy": 16,
    "token_classes_any_and_exact": 12,
    "token_parts_on_rise": 5,
    "label_token_rates": 12,
    "missed_tokens_by_label": 12,
    "modal_label_first_seen": 12,
    "phi_tokens_without_signs": 12,
    "token_comparison": 12,
    "token_alignment": 12,
}


@pytest.mark.parametrize("name", TOKEN_QUERIES)
def test_token_labels_by_note(spark, odd_spans, name):
    """The rows of the SQL, from a plan that shuffles notes and spans but no characters."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, odd_spans)
    assert _exchanges(df) <= TOKEN_QUERIES[name]
    con = duckdb.connect()
    for t in ("input_examples", "gold_annotations", "predictions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd_spans}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    assert df.columns == [c[0] for c in want.description]
    rounded = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    got = rounded(df.collect())
    assert got == rounded(want.fetchall()) and got
