"""Language and quality: accuracy on held-out documents, and the edges."""

import zlib

import numpy as np

from sceneline.llm import langid, quality

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify_table(docs).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["lang_pred"] in {*lang.values(), "und"} for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.95
    assert sum(r["rejected"] for r in got) < 0.01 * len(got)


def test_language_edges(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house of the dog", "en"), ("la maison du chien", "fr"), (None, "en"), ("no language", None), ("123", "en")] * 4)]
    docs = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog and the cat"), (5, "le chat du chien"), (5, "le chat du chien"), (None, "the dog"), (6, "the dog " * 100_000), (7, "Жизнь"), (8, "日本語")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang_pred string, score int")
    got = langid.identify(frame, spark.createDataFrame(train, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 3))
    assert [by[i]["lang_pred"] for i in (4, 5, None, 6)] == ["en", "fr", "en", "en"]
    assert by[7]["lang_pred"] in ("en", "fr") and by[7]["rejected"] and by[8]["rejected"]
    nothing = langid.identify(frame, spark.createDataFrame([], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(frame.limit(0), spark.createDataFrame(train, "doc_id long, text string, lang string")).count() == 0


def test_noise_and_other_languages_are_rejected(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    noise = [
        " ".join(word() for _ in range(400)),
        " ".join(word() for _ in range(120)),
        "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 2000)),
        "Suomen kieli kuuluu uralilaiseen kielikuntaan ja sitä puhuu äidinkielenään noin viisi miljoonaa ihmistä. Kielessä on viisitoista sijamuotoa, eikä siinä ole lainkaan kieliopillista sukua.",
        "Język polski należy do grupy języków zachodniosłowiańskich i jest językiem urzędowym w Polsce. Posługuje się nim około czterdziestu milionów ludzi na całym świecie.",
        "Русский язык является одним из восточнославянских языков и государственным языком России.",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    clean = docs.where("doc_id % 5 = 0").selectExpr("doc_id", "substring(text, 1, 40 + cast(doc_id % 400 as int)) AS text", "lang").unionByName(docs)
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    got = langid.identify(clean.select("doc_id", "text").union(planted), docs.where(~langid.held_out())).collect()
    assert [noise[-1 - r["doc_id"]][:30] for r in got if r["doc_id"] < 0 and not r["rejected"]] == []
    kept = [not r["rejected"] for r in got if r["doc_id"] >= 0]
    assert np.mean(kept) > 0.99


def test_chunks_add_up(monkeypatch):
    text = "Ein Satz mit Wörtern, und noch einer. " * 50
    whole, _ = langid.counts([text])
    monkeypatch.setattr(langid, "CHUNK", 100)
    cut, _ = langid.counts([text])
    assert abs(whole - cut).sum() <= 4  # the border of the last chunk


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.score_table(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    out = [(truth[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for y, s in out if y == 1], [s for y, s in out if y == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "word " * 200_000, 2), (None, "x", 2), (4, "ok fine", 2), (4, "ok fine", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (2, 0), (2, 1), (9, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score(docs, docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2]
    assert {r["score"] for r in quality.score(docs, docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, docs, spark.createDataFrame([(4, 1)], "doc_id long, quality int")).collect()} == {1.0}
    assert quality.score(docs.limit(0), docs, labels).count() == 0


def test_gradient():
    """The written-out gradient moves as the loss does: training separates bags by one telling passage."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 6, 200)
    x = rng.normal(0, 1, (sizes.sum(), quality.FEATURES))
    y = (np.arange(200) % 2).astype(float)
    first = np.cumsum(sizes) - sizes
    x[first[y == 1], 3] += 6  # only one passage of a good document tells
    m = quality.train(x, sizes, y, np.ones(200))
    s = m.forward(x, sizes)["s"]
    assert ((s > 0.5) == (y == 1)).mean() > 0.95


def test_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    """An id with ten thousand rows is fitted on once."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain, collected, collect = [], DataFrame.toPandas, [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: seen.append(plain(self)) or seen[-1])
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    rows = [(1, f"the cat and the dog {i % 100}", "en") for i in range(10_000)] + [(i, "le chat et le chien", "fr") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert set(langid.fit(docs).langs) == {"en", "fr"}
    sizes = {r["lang"]: r["rows"] for found in collected for r in found if "centroids" in r}
    assert sizes["en"] == 1 and 30 < sizes["fr"] <= 38
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, quality int")
    assert quality.fit(docs, labels).p
    marked = seen[0]
    assert (marked["doc_id"] == 1).sum() == 1 and 30 < len(marked) <= 39


def test_a_dirty_language_column_is_bounded(spark, monkeypatch):
    """Of ten thousand values of lang those with the most rows are learned; the driver gets no text."""
    from pyspark.sql.classic.dataframe import DataFrame

    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    rows = [(i, f"the cat and the dog {i}", f"x{i:05d}") for i in range(10_000)] + [(20_000 + i, "le chat et le chien " * (1 + i % 9), "fr") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert sorted(set(model.langs)) == ["fr", "x00000", "x00001", "x00002", "x00003"] and model.fallback == "fr"
    assert max(len(found) for found in collected) <= langid.DIM + 1
    assert model.predict(["le chien et le chat"])[0] == ["fr"]


def test_a_very_long_text_is_fitted_on_a_bounded_number_of_passages(spark, monkeypatch):
    """Passages over the whole text, the last one too; ids of another type pass through."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: seen.append(plain(self)) or seen[-1])
    docs = spark.createDataFrame([("a", "Some words, and more. " * 1_000_000), ("b", "x1!" * 400)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, docs, labels).collect()}
    assert got["a"] > got["b"]
    assert max(len(x) for x in seen[0]["x"]) == quality.SAMPLE_PASSAGES * quality.FEATURES * 2
    x = np.arange(2000.0).reshape(1000, 2)
    assert quality.spread(x)[0, 0] == 0 and quality.spread(x)[-1, 1] == 1999 and (quality.spread(x[:9]) == x[:9]).all()
