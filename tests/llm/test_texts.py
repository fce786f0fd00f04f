import numpy as np
import pytest

from veldra.llm import dialogue, tokens
from veldra.llm.forest import Forest
from veldra.llm.leaks import leaked_items, without_leaks
from veldra.llm.repetition import repetition_scores, repetition_statistics, repetitive_documents

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world's end, we'll see 123 <|endoftext|>!", "naïve café — “quotes” …\r\n\ttab", "日本語テキスト 한국어 русский текст", "a b c\x85d\x1ce", "😀👨‍👩‍👧 é", "\x00\x07 ctrl",
    "ࡰ new letter \U0001F6DC new sign", "word " * 30_000, "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\n\n", "'s 'S don't I'LL", "   leading", "trailing   ", "ÐŸÑ€Ð¸Ð²ÐµÑ‚ ³ÿ",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "l", 5) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, ids int").repartition(3)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_ids_equal_the_tokenizer_and_decode_to_the_text(spark, docs, limit):
    encoded = tokens.encode_corpus(docs, table_bytes=limit)
    own = tokens._tokenizer(tokens.VOCABULARY)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_no_documents(spark, docs):
    none = docs.limit(0)
    assert tokens.encode_corpus(none).count() == 0 and tokens.encode_corpus(none, table_bytes=0).count() == 0
    assert repetition_scores(none).count() == 0 and repetitive_documents(none).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_items(none, docs.withColumnRenamed("doc_id", "item_id")).count() == 0 and leaked_items(docs, items).count() == 0


def brute_share(words, n=6):
    seen, cover = set(), np.zeros(len(words), bool)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            cover[i : i + n] = True
        seen.add(g)
    return float(cover.mean()) if len(words) else 0.0


def test_shares_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"W{x}" for x in rng.integers(0, 3 + i, 5 * i))) for i in range(60)] + [(90, None), (91, ""), (92, "--- 12\n00:01 --> 2"), (93, "one two"), (94, "so " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.repeated_share) for r in repetition_statistics(df).collect()}
    for i, t in rows[:60]:
        words = (t or "").lower().split()
        assert got[i] == (len(words), pytest.approx(brute_share(words)))
    assert got[90] == got[91] == (0, 0.0) and got[93] == (2, 0.0) and got[94][1] == pytest.approx(1 - 1 / 50_000)


def test_cues_and_markup_are_not_words(spark):
    cue = "{n}\n00:00:0{n},000 --> 00:00:09,000\n<i>one two</i> {{x}}three\nFOUR five six\n\n"
    df = spark.createDataFrame([(1, "".join(cue.format(n=n) for n in range(4)))], "doc_id bigint, text string")
    r = repetition_statistics(df).first()
    assert r.n_words == 24 and r.repeated_share == 0.75


def test_repetitive_documents_are_all_found(spark):
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        if i % 11 == 0:
            at = int(rng.integers(8, 40))
            words = words[:60] + words[: 60 - at] + words[60 : 60 + at] if i % 2 else words[:20] * 6
        rows.append((i, " ".join(words)))
        if brute_share(words) >= 0.30:
            want.add(i)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in repetitive_documents(df).collect()} == want and len(want) > 20


def test_the_forest_and_its_threshold_come_from_all_documents(spark):
    """Of 4300 ordinary documents only the one of the greatest hashed id repeats a word: it is the odd one."""
    ids = spark.range(4300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', i))) AS text")
    odd = ids.selectExpr("max_by(doc_id, xxhash64(cast(doc_id AS string), 1729)) AS d").first().d
    docs = ids.selectExpr("doc_id", f"if(doc_id = {odd}, concat(text, ' w1 w2'), text) AS text")
    scores = {n: {r.doc_id: (r.score, r.anomalous) for r in repetition_scores(docs.repartition(n)).collect()} for n in (1, 5)}
    assert scores[1] == scores[5] and len(scores[1]) == 4300
    assert all(scores[1][odd][0] > s for i, (s, _) in scores[1].items() if i != odd)


def test_levels_of_ranges_are_those_of_the_rows():
    """Ranges of parts of the rows combine to those of all rows, at every level of a growing forest."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 4)), 1)
    forest, draws, level = Forest.bare(9, 4), np.random.default_rng(1), 0
    while True:
        parts = [forest.ranges(p, level) for p in np.array_split(x, 3)]
        whole = forest.ranges(x, level)
        assert sum(p[1].sum() for p in parts) == whole[1].sum() and (whole[0] < 9 * 2**level).all()
        for place, n, low, high in zip(*whole):
            mine = [tuple(c[i] for c in p[1:]) for p in parts for i in np.flatnonzero(p[0] == place)]
            assert n == sum(m[0] for m in mine) and (low == np.min([m[1] for m in mine], axis=0)).all() and (high == np.max([m[2] for m in mine], axis=0)).all()
        if not forest.grow(level, *whole, draws):
            break
        level += 1
    assert level == 4 and (forest.score(np.full((1, 4), 9.0)) > forest.score(np.zeros((1, 4)))).all()


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    s = Forest.fit(x, 50).score(np.array([[0.0, 0, 0], [9.0, 9, 9]]))
    assert s[1] > s[0] + 0.15 and Forest.fit(np.zeros((0, 2))).score(np.zeros((2, 2))).shape == (2,) and Forest.fit(np.ones((9, 2))).score(np.ones((1, 2)))[0] <= 1


ITEM = "The gentle fenny mars opened what Lärisris had left behind 60 old courtyard walls until that nervous holdrequo found a window"


def broken(words):
    return f"7\n00:00:01,000 --> 00:00:02,000 align:start\n<i>Prologue words go here</i>\n{words}\n\n8\n00:00:03,000 --> 00:00:04,000\nAnd nothing else."


W = ITEM.split()
LEAKS = {
    "whole": broken(ITEM), "twelve": broken("Well " + " ".join(W[:13]) + " Bye"), "cues": broken("\n\n9\n00:00:05,000 --> 00:00:06,000\n".join([" ".join(W[:6]), " ".join(W[6:14])])),
    "case and accents": broken(ITEM.upper().replace("Ä", "A")), "punctuation": broken(", ".join(W)), "markup": broken("<b>" + " [door] ".join([" ".join(W[:5]), "{\\an8}" + " ".join(W[5:14])]) + "</b>"),
    "numbers": broken(ITEM.replace("60", "61")), "encoding": broken(ITEM.encode().decode("latin-1")), "lost letters": broken(ITEM.replace("ä", "?")), "misread": broken(ITEM.replace("old", "0ld").replace("left", "1eft").replace("window", "vvinclovv").replace("mars", "rnars").replace("nervous", "ncrvous")),
    "joined lines": broken("\r\n".join(W)), "html": broken("&quot;" + ITEM + "&quot;"), "one bad word": broken(ITEM.replace("courtyard", "courtyxrd")), "long": "noise " * 50_000 + ITEM,
}
NO_LEAKS = {"eleven": broken(" ".join(W[:10])), "order": broken(" ".join(reversed(W))), "gap": broken(" ".join(W[:9]) + " something else here " + " ".join(W[9:17])), "null": None, "empty": "", "numbers only": "1 2 3"}


def leaks(spark, texts, item=ITEM, **how):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(5, item, "en"), (6, "short one", None), (7, None, None), (8, "", "x"), (5, item, "en")], "item_id bigint, text string, lang string")
    return leaked_items(docs, items, **how)


def test_leaks_in_all_states_of_damage(spark):
    got = leaks(spark, LEAKS.values()).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 5) for i in range(len(LEAKS))], set(range(len(LEAKS))) - {r.doc_id for r in got}


def test_no_leaks(spark):
    assert leaks(spark, NO_LEAKS.values()).collect() == []


def test_items_in_blocks_and_removal(spark):
    texts = [*LEAKS.values(), *NO_LEAKS.values()]
    a, b = leaks(spark, texts), leaks(spark, texts, item_bytes=20)
    assert sorted(a.collect()) == sorted(b.collect())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert without_leaks(docs, a).count() == len(NO_LEAKS)


RUSSIAN = "Сам Тимирпал починил далёкую лестницу в тёмном замке когда Еллюбор никогда не сосчитал чужую лопату как всегда"


@pytest.mark.parametrize("damage", [lambda t: t, lambda t: t.encode().decode("latin-1"), lambda t: t.encode("cp1251").decode("latin-1"), lambda t: t.encode("koi8-r").decode("cp1251"), lambda t: t.replace("о", "0").replace("з", "3"), lambda t: t.replace("ё", "е").upper()])
def test_cyrillic_damage(spark, damage):
    assert leaks(spark, [damage(RUSSIAN)], RUSSIAN).count() == 1


def test_rolling_captions_count_once():
    text = "1\n00:01 --> 00:02\none two\nthree four\n\n2\n00:02 --> 00:03\nthree four\nfive six"
    assert dialogue.tokens(text) == ["one", "two", "three", "four", "five", "six"]


def test_a_word_misread_into_another_items_word(spark):
    items = [(1, "the captain found seven candles under every marble bridge before winter came again"), (2, "nobody at the station saw a handle or the heavy copper bucket that day")]
    docs = [
        (1, "The captain found saven candles under every marble bridge before winter came again"),
        (2, "The captain found seven stations under every marble bridge before winter came again"),
        (3, "00:01 --> 00:02\nThe captain found seven [" + "a very long sound " * 30 + "]\ncandles under every marble\n\n2\n00:03 --> 00:04\nbridge before [winter came again"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items + [(3, "a station with handles and saven that stations bring")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, i).collect()} == {(1, 1), (3, 1)}
