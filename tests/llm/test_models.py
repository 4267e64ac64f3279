"""Mixing, language, toxicity, and the pipeline."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import language, mixing, toxicity
from tidemark.llm.common import held_out, read
from tidemark.llm.registry import ORACLE_SQL, QUERIES

from .conftest import DATA, texts


def fill(sizes, weights, total, epochs):
    """Clamp, reshare, repeat."""
    left, open_, out = total * sum(sizes), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / w > epochs * sizes[i]]
        if not full:
            return [out.get(i, left * weights[i % len(weights)] / w) for i in range(len(sizes))]
        for i in full:
            out[i] = epochs * sizes[i]
            open_.discard(i)
        left = total * sum(sizes) - sum(out.values())
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 50, 500, 5000]) for _ in range(9)]
    df = spark.createDataFrame([(None if i == 8 else f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    assert [got[None if i == 8 else f"s{i}"] for i in range(9)] == pytest.approx(want)


def by_sql(df):
    duck = duckdb.connect()
    duck.register("documents", df.toArrow())
    return sorted(duck.execute(ORACLE_SQL["op3_mixing"]).fetchall(), key=repr)


MIXED = ("doc_id", "size", "source_size", "target", "taken", "source")


def test_mixing_query(spark):
    got = QUERIES["op3_mixing"](spark, DATA)
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(read(spark, DATA, "documents"))


@pytest.mark.parametrize("rows", [
    [(1, "w " * 10, "a")] * 100 + [(2, "w " * 7, "a")],
    [(None, "w " * 10, "a")] * 100 + [(2, "w " * 16, "a")],
    [(i, "w " * (20_000 if i == 500 else 100), "a") for i in range(1001)] + [(2000 + i, "w " * 333, "b") for i in range(50)],
    [(i, "w " * random.Random(i).choice([1, 3, 50, 700, 6000]), random.Random(-i).choice(["a", "b", "c", None])) for i in range(300)],
], ids=["equal rows", "null ids", "one long text", "many sizes"])
def test_mixing_is_greedy_and_near(spark, rows):
    df = texts(spark, rows).repartition(5)
    got = [tuple(r) for r in mixing.mix(df).select(*MIXED).collect()]
    assert sorted(got, key=repr) == by_sql(df)
    for source in {r[5] for r in got}:
        own = [r for r in got if r[5] == source]
        spare = [r[1] for r in own if r[4] == own[0][3] // own[0][2] * r[1]]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= min(spare, default=max(r[1] for r in own)) / 2 and all(r[4] <= 2 * r[1] for r in own)
    words = Counter()
    for r in mixing.mixed(df).collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert all(abs(words[r[5]] - r[3]) <= 0.03 * r[3] for r in got)


def test_mixed_documents_tell_rows_apart(spark):
    """Rows with one id, one size and other texts or columns are taken by themselves."""
    rows = [(5, f"t{i % 3} " * 10, "a") for i in range(30)] + [(6, "z " * 9, "a")] * 21 + [(None, None, "a"), (None, "", None)]
    df = texts(spark, rows).withColumn("extra", F.col("doc_id") * 2).withColumn("size", F.lit("x"))
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(df).collect())
    target = 1.5 * (30 * 10 + 21 * 9)
    assert abs(sum(len((t or "").split()) * n for (_, t, _), n in got.items()) - target) <= 5
    assert all(10 <= got[5, f"t{i} " * 10, "a"] <= 20 for i in range(3)) and 21 <= got[6, "z " * 9, "a"] <= 42 and got[None, None, "a"] == got[None, "", None] == 1
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixed(df).columns == df.columns


def test_mixing_meets_targets_and_repeats(spark):
    df = texts(spark, [(i, "w " * (1 + i % 13), None if i % 5 == 0 else f"s{i % 5}") for i in range(4000)])
    got = mixing.mix(df).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(9)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 7 for s, t in target.items())


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mix(odd)
    assert got.count() == 10 and got.where("doc_id IN (2, 3, 4)").agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix(empty).count() == 0


def test_language_distance_by_hand():
    profiles = language.Profiles({"x": language.grams("aaa bbb")[0][:5], "y": language.grams("zzz yyy")[0][:5]}, 5)
    assert profiles.predict("aaa bbb") == ("x", 1.0) and profiles.predict("zzz yyy")[0] == "y"
    assert profiles.predict("12 34 !!") == ("und", 0.0) == profiles.predict(None)
    assert language.Profiles({}, 5).predict("aaa") == ("und", 0.0)


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    c = Counter()
    joined = " " + " ".join(words) + " "
    for w in words:
        c.update(w)
    for n in (2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if n == 2 or g[1] != " ":
                c[g] += 1
    key = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return sorted(((key(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("text", ["Hello, hello world", "Éa éa", "a1b", "x"])
def test_grams_equal_a_plain_count(text):
    keys, counts = language.grams(text)
    assert list(zip(keys.tolist(), counts.tolist(), strict=True)) == plain_grams(text)


def test_profiles_equal_a_plain_count(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeéö", k=rng.randint(1, 7))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=700)), f"l{i % 3}") for i in range(30)]  # far more n-grams a text than a profile ranks
    got = language.learn(texts(spark, rows, "doc_id long, text string, lang string").repartition(5), top=250)
    for lang in ("l0", "l1", "l2"):
        total = Counter()
        for _, t, own in rows:
            if own == lang:
                total.update(dict(plain_grams(t)))
        assert got[lang].tolist() == [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:250]]


def test_every_gram_of_a_training_text_counts(spark):
    """An n-gram that is rare in each text, but in all of them, outranks those that are frequent in one."""
    many = ["".join(x) for x in itertools.islice(itertools.product("bcdfghjklm", repeat=3), 700)]
    rows = [(i, " ".join(w for w in many[i * 60 : i * 60 + 60] for _ in range(3)) + " " + " ".join(many) + " zqx", "l") for i in range(10)]
    top = 1200
    got = language.learn(texts(spark, rows, "doc_id long, text string, lang string"), top=top)["l"].tolist()
    total = Counter()
    for _, t, _ in rows:
        total.update(dict(plain_grams(t)))
    assert got == [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]]


def plain_predict(text, profiles, top):
    own = [k for k, _ in plain_grams(text or "")][:top] if re.search(r"[^\W\d_]", text or "") else []
    if not own:
        return "und"
    place = {lang: {g: r for r, g in enumerate(p.tolist())} for lang, p in profiles.items()}
    away = {lang: sum(min(abs(r[g] - i), top) if g in r else top for i, g in enumerate(own)) for lang, r in place.items()}
    return min(away, key=lambda x: (away[x], x))


def test_language_equals_a_plain_version(spark):
    docs = read(spark, DATA, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(~held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, profiles).collect()}
    rows = [r for r in docs.collect() if r["text"] is None or r["text"].isascii()]
    assert rows and all(got[r["doc_id"]] == plain_predict(r["text"], profiles, language.TOP) for r in rows)


def test_equally_near_languages_go_by_name(spark):
    rows = texts(spark, [(1, "one text of words", "b"), (2, "one text of words", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(rows, language.learn(rows)).collect()} == {"a"}


def test_language_query(spark):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, DATA, "documents").collect()}
    got = QUERIES["op10_language"](spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(held) >= 0.95 * len(held)


def test_language_odd_rows(spark, odd, empty):
    got = {r["doc_id"]: r for r in language.identify(odd, language.learn(odd)).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[6]["lang_pred"] == "en"
    assert language.identify(empty, language.learn(empty)).count() == 0


CLEAN = ["the", "river", "runs", "over", "stones", "and", "grass", "while", "birds", "sing", "in", "trees", "of", "autumn", "light", "softly", "falling", "down"]
BAD = ["idiot", "stupid", "moron", "worthless"]


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(CLEAN, k=60) + [f"n{rng.randint(0, 999)}"]
        toxic = i % 6 == 0
        if toxic:
            for b in rng.sample(BAD, 2):
                words.insert(rng.randrange(60), b)
        docs.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    return texts(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_restores(spark, odd, empty):
    docs, labels = labelled(spark)
    model = toxicity.Model(docs, labels)
    hidden = ["the river 1d10t and st.up.id grass", "the birds i d i o t and m o r o n sing", "stuuuupid w0rthless river", "the m0r0n! st*pid"]
    clean = ["the river runs over stones", "birds 1234 sing in 2nd trees a b c d", "AKIA6JWTUBUC2 and e3b3ed3cc854", ""]
    rows = texts(spark, [(i, t, "a") for i, t in enumerate(hidden + clean)])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert all(got[i] >= 0.5 for i in range(3)) and all(got[4 + i] < 0.5 for i in range(4))
    held = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs.where(held_out(F.col("doc_id"))), model).collect()}
    assert sum(held[i] == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    other = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert len(other) == 9 and other[2] == other[3] < 0.5
    assert toxicity.score(empty, toxicity.Model(empty, labels)).count() == 0


def test_toxicity_keeps_rare_insults(spark):
    """Insults in a hundredth of the toxic rows and in no clean one, beside one in nearly all of them."""
    rng = random.Random(5)
    rare = [f"{a}{b}ard" for a in ("brag", "drun", "slug", "wiz", "cow") for b in ("g", "k", "z", "p")]
    plain = ["".join(rng.choices("aeioulmnrst", k=6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(4000):
        words = rng.choices(CLEAN + plain, k=40)
        if i % 2:
            words.insert(rng.randrange(40), rng.choice(rare) if i % 5 == 0 else "idiot")
        docs.append((i, " ".join(words), "a"))
        labels.append((i, i % 2))
    model = toxicity.Model(texts(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(rare) <= set(model.weights), sorted(set(rare) - set(model.weights))
    rows = texts(spark, [(i, f"the river {w} runs", "a") for i, w in enumerate([*rare, "idiot", "runs"])])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert [got[i] >= 0.5 for i in sorted(got)] == [True] * (len(rare) + 1) + [False], (got, model.slope, model.shift)


def test_toxicity_segments_runs_of_single_characters(spark):
    docs, labels = labelled(spark)
    model = toxicity.Model(docs, labels)
    long = " ".join("the river runs over green stones and cold water stupid".replace(" ", ""))
    hidden = ["the river a s t u p i d", "i d i o t m o r o n", "t h e r i v e r i d i o t", "the s  t  u  p  i  d river", "the i\td\ti\to\tt river", "the s\nt\nu\np\ni\nd river", long]
    clean = ["t h e r i v e r r u n s", "a  b  c  d", "1 2 3 4 5 6 7 8 9 " * 40]
    rows = texts(spark, [(i, t, "a") for i, t in enumerate(hidden + clean)])
    got = {r["doc_id"]: round(r["score"], 2) for r in toxicity.score(rows, model).collect()}
    assert [got[i] >= 0.5 for i in got] == [True] * len(hidden) + [False] * len(clean), got


def test_toxicity_reads_doubled_letters_marks_and_long_stretches(spark):
    docs, labels = labelled(spark)
    model = toxicity.Model(docs, labels)
    hidden = ["the stuupid river", "the iddiot river", "the i/d/i/o/t river", "the i~d~i~o~t, river", "the i...d...i...o...t river", "the r1verrunsovergreenstonesandst0nes1d10t river"]
    clean = ["a/b/c/d", "the grass runs", "e3b3ed3cc854" * 8, "-" * 20000, "e.g. and i.e. 1/2/3/4"]
    rows = texts(spark, [(i, t, "a") for i, t in enumerate(hidden + clean)])
    got = {r["doc_id"]: round(r["score"], 2) for r in toxicity.score(rows, model).collect()}
    assert [got[i] >= 0.5 for i in sorted(got)] == [True] * len(hidden) + [False] * len(clean), got


@pytest.fixture(scope="module")
def judge(spark):
    return toxicity.Model(*labelled(spark))


@pytest.mark.parametrize("hidden", [
    "you are m o r o n today", "you are a m o r o n today", "i d i o t a n d m o r o n", "the mo ron sings", "the stu pid, river", "sssttuuppiidd grass", "s/t/u/p/i/d grass",
    "s...t...u...p...i...d grass", "the m\u200bo\u200br\u200bo\u200bn sings", "the mo\u200bron sings", "the ww oo rr tt hh ll ee ss ss", "worthless" + "s" * 60, "w o r t h l e s s " + "r i v e r " * 9,
    "r i v e r " * 9 + "w o r t h l e s s", "w.o.r.t.h.l.e.s.s." + "r.i.v.e.r." * 9, "st\u0336u\u0336p\u0336i\u0336d\u0336",
])
def test_toxicity_reads_any_spacing(judge, hidden):
    scorer = toxicity.Scorer(judge.weights, judge.slope, judge.shift, toxicity.CharacterModel(judge.letters, judge.counts))
    assert scorer.score(scorer.evidence([hidden])[0]) >= 0.5


@pytest.mark.parametrize("clean", ["the river and grass", "a b c d e f", "in trees, of au tumn light", "st and on", "x = y * z + (a | b)", "****** ++++++ |||||", "birds of a river i d"])
def test_toxicity_leaves_clean_spacing(judge, clean):
    scorer = toxicity.Scorer(judge.weights, judge.slope, judge.shift, toxicity.CharacterModel(judge.letters, judge.counts))
    assert scorer.score(scorer.evidence([clean])[0]) < 0.5


def test_very_long_words_are_features():
    words = ["x" * 50, "x" * 51]
    assert len({toxicity.features_of(w)[0] for w in words}) == 2 and all(toxicity.features_of(w)[0][0] == "#" for w in words)


def brute_restore(model, noisy):
    """All readings of a short stretch, the best by score."""
    best = None

    def go(i, a, b, score, text):
        nonlocal best
        if i == len(noisy):
            s = score + model.log[model.place.get(a, 1) if a else 0, model.place.get(b, 1) if b else 0, 0]
            best = max(best or (s, text), (s, text))
            return
        c = noisy[i]
        options = [(c, toxicity.KEEP)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
        for x, cost in options:
            go(i + 1, b, x, score + cost + model.log[model.place.get(a, 1) if a else 0, model.place.get(b, 1) if b else 0, model.place.get(x, 1)], text + x)
        if not c.isalnum():
            go(i + 1, a, b, score + toxicity.DROP, text)
        if b and any(x == b for x, _ in options):
            go(i + 1, a, b, score + toxicity.REPEAT, text)

    go(0, "", "", 0.0, "")
    return best[1]


def test_viterbi_equals_all_readings(spark):
    docs, _ = labelled(spark, 120)
    model = toxicity.CharacterModel(*toxicity.letter_counts(docs))
    for noisy in ("1d10t", "i.d.1", "st00p", "mooo", "s-t*p", "w0r7h", "!|1", "*|*!1"):
        assert model.read(noisy) == brute_restore(model, noisy)


def test_no_state_is_pruned(spark):
    """Marks that may each be one of several letters: more than 48 states, the best path among all of them."""
    docs, _ = labelled(spark, 120)
    model = toxicity.CharacterModel(*toxicity.letter_counts(docs))
    for noisy in ("s*!|+$@d", "1*|$*+b"):
        assert model.read(noisy) == brute_restore(model, noisy)


def test_letter_counts_equal_a_plain_count(spark):
    found = ["abc ab", None, "", "Zé a"]
    letters, counts = toxicity.letter_counts(texts(spark, [(i, t, "a") for i, t in enumerate(found)]))
    place = {c: i + 2 for i, c in enumerate(letters)}
    base, want = toxicity.ALPHABET + 3, Counter()
    for t in found:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            s = [0, 0, *[place.get(c, 1) for c in w], 0]
            want.update((s[i] * base + s[i + 1]) * base + s[i + 2] for i in range(len(s) - 2))
    assert counts == dict(want)


def test_toxicity_query(spark):
    got = QUERIES["op9_toxicity"](spark, DATA).collect()
    assert len(got) == read(spark, DATA, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in read(spark, folder, "labels").collect()}
    got = [(r["score"], toxic[r["doc_id"]], r["predicted"]) for r in QUERIES["op9_toxicity"](spark, folder).where("held_out").collect() if toxic.get(r["doc_id"]) is not None]
    bad, good = [x for x in got if x[1]], [x for x in got if not x[1]]
    above = sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a in bad for b in good) / (len(bad) * len(good))
    caught, wrong = sum(x[2] for x in bad) / len(bad), sum(x[2] for x in good) / len(good)
    assert above >= 0.92 and caught >= 0.85 and wrong <= 0.01, (above, caught, wrong)


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 400)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(1)
    banner = "this very site is brought to you by the same banner"
    body = lambda: " ".join(rng.choices(CLEAN, k=80) + [f"u{rng.randint(0, 10**6)}" for _ in range(30)])
    more = [(1000 + i, f"{banner}\n{body()}", f"s{i % 15}") for i in range(45)]
    copy = body()
    more += [(2000 + i, copy + f" tail{i}", "s1") for i in range(5)] + [(3000, "stupid idiot moron " + body(), "s2"), (3001, None, "s2"), (3002, "", "s3")]
    every = texts(spark, more).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "extra": F.lit(1)})
    every = every.unionByName(docs.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "extra": F.lit(1)}))
    steps, got = {}, every
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, got, str(tmp_path)).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        steps[name] = got.collect()
        if name != "bpe":
            assert got.columns == corpus_pipeline.COLUMNS
    ids = {n: {r["doc_id"] for r in rows} for n, rows in steps.items()}
    assert 3000 not in ids["toxicity"] and {1000 + i for i in range(45)} | {2000, 3001, 3002} <= ids["toxicity"]
    lines = {r["doc_id"]: r for r in steps["line_dedup"]}
    assert lines[1000]["text"].startswith(banner) and not any(lines[1000 + i]["text"].startswith(banner) for i in range(1, 45))
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in lines.values()) and {3001, 3002} <= set(lines)
    assert ids["line_dedup"] - ids["ngram_jaccard_join"] >= {2001, 2002, 2003, 2004} and 2000 in ids["ngram_jaccard_join"]
    taken = Counter(r["doc_id"] for r in steps["mixing"])
    size = lambda rows: Counter({s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    before, after = size(steps["ngram_jaccard_join"]), size(steps["mixing"])
    names = sorted(before)
    for s, want in zip(names, fill([before[x] for x in names], (3, 1, 2), 1.5, 2.0), strict=True):
        assert abs(after[s] - want) <= 60
    assert set(taken) <= ids["ngram_jaccard_join"] and max(taken.values()) <= 2
    assert Counter(r["doc_id"] for r in steps["bpe"]) == taken


def through(spark, docs, tmp_path, name="run"):
    """docs through all stages, each written and read again: the rows of each step."""
    steps = []
    for stage_name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{stage_name}"))
        docs = spark.read.parquet(str(tmp_path / f"{name}-{stage_name}"))
        steps.append(docs.collect())
    return steps


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """Repeated rows, equal ids with other texts, null ids, and an empty table."""
    docs, labels = labelled(spark, 200)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(2)
    t, u, v = (" ".join(rng.choices(CLEAN, k=50) + [f"{c}{i}" for i in range(40)]) for c in "xyz")
    rows = [(1, t, "a"), (5, t, "a"), (5, u, "a"), (None, v, "b"), (None, v, "b"), (None, None, "b"), (8, "", None), (9, "", None), (9, "", None)]
    own = texts(spark, rows).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "size": F.lit("?"), "_row": F.lit(1)})
    toxic, lines, near, mixed, coded = through(spark, own, tmp_path)
    assert len(toxic) == len(lines) == 9
    assert Counter((r["doc_id"], r["text"]) for r in near) == Counter([(1, t), (5, u), (None, v), (None, None), (8, ""), (9, ""), (9, "")])
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed) and {r["text"] for r in mixed} == {t, u, v, None, ""}
    none = through(spark, own.limit(0), tmp_path, "none")
    assert [len(x) for x in none] == [0] * 5


def test_pipeline_takes_repeated_rows_as_often_as_they_fit(spark, tmp_path):
    """102 documents of one source, which has one and a half times its words as the target."""
    rows = [(1, "w " * 10, "a")] * 100 + [(2, "v " * 10, "a"), (3, "u " * 10, "a")]
    own = texts(spark, rows).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, own, str(tmp_path)).collect())
    assert sum(got.values()) == 153 and all(1 <= got[i] <= 2 for i in (2, 3))


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
