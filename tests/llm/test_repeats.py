import random
from collections import Counter

from lexisweep.llm import registered, repeats


def plain(rows):
    """rows: (doc_id, text).  All runs of all texts, by their words."""
    seen = {}
    every = []
    for i, text in rows:
        found = repeats.sentences(text or "")
        starts = [s for s, _ in found] + [len(text or "")]
        runs = set()
        n = len(found)
        for a in range(n):
            for b in range(a + 1, n + 1):
                size = lambda x, y: y - x >= 2 and sum(len(w) for _, w in found[x:y]) >= 12
                if size(a, b) and (not size(a, b - 1) or not size(a + 1, b)):
                    runs.add((a, b))
        keys = [(tuple(" ".join(w).lower() for _, w in found[a:b]), starts[a], starts[b]) for a, b in runs]
        every.append(keys)
        for key, a, _ in keys:
            place = (i is None, i or 0, a)
            seen[key] = min(place, seen.get(key, place))
    out = []
    for (i, text), keys in zip(rows, every):
        gone = set()
        for key, a, b in keys:
            if (i is None, i or 0, a) > seen[key]:
                gone.update(range(a, b))
        kept = None if text is None else "".join(c for k, c in enumerate(text) if k not in gone)
        out.append((i, kept, None if text is None else len(text) - len(kept)))
    return out


def shown(rows):
    return Counter((str(i), t, n) for i, t, n in rows)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 15))) + rng.choice(". |! |\n|.\n|? ".split("|"))
    passages = ["".join(sentence() for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(10)]
        parts.insert(rng.randrange(10), rng.choice(passages))
        rows.append((i, "".join(parts)))
    rows += [(50, rows[3][1]), (51, "loop " * 300), (52, "word " * 40_000), (53, ""), (54, None), (55, " \n "), (None, rows[4][1])]
    return rows + [rows[0], rows[41]]


def test_sentences_cover_the_text():
    for _, text in corpus():
        found = repeats.sentences(text or "")
        assert [w for _, words in found for w in words] == (text or "").split()
        starts = [s for s, _ in found]
        assert starts == sorted(set(starts)) and starts[:1] in ([], [0])


def test_rows(spark):
    rows = [r for r in corpus() if r[0] != 52]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, digest string")
    out = repeats.remove_repeats(df)
    assert out.columns == [*df.columns, "cut_chars"]
    got = out.select("doc_id", "text", "cut_chars").collect()
    assert shown(map(tuple, got)) == shown(plain(rows))
    assert repeats.remove_repeats(df.limit(0)).collect() == []


def test_long_text(spark):
    df = spark.createDataFrame(corpus()[-6:-4] + [(52, "word " * 40_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert out[52].text == "word " * 25 and out[52].cut_chars == 5 * (40_000 - 25)


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    out = registered.QUERIES["op10_repeats"](spark, data).collect()
    assert shown((r.doc_id, r.text, r.cut_chars) for r in out) == shown(plain([tuple(r) for r in rows]))


def repeated_words(rows, size):
    """Per text, whether each word is in a run of ``size`` words that stands in an
    earlier text or place; on words alone."""
    seen, out = set(), []
    for _, text in rows:
        words = text.lower().split()
        marks = [False] * len(words)
        for k in range(len(words) - size + 1):
            run = tuple(words[k : k + size])
            if run in seen:
                marks[k : k + size] = [True] * size
            seen.add(run)
        out.append(marks)
    return out


def test_long_sentences_fall_in_step(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(80) for _ in range(4)]
    rows = []
    for i in range(60):
        # In mid-sentence: the passage's place in its sentence differs from text to text.
        words = some(rng.randrange(26)) + passages[i % 4] + some(rng.randrange(26))
        if i % 3 == 0:
            del words[rng.randrange(30)]
        rows.append((i, " ".join(words) + ". " + " ".join(some(8)) + "."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in repeats.remove_repeats(df).collect()}
    for (i, text), wide, narrow in zip(rows, repeated_words(rows, 50), repeated_words(rows, 12)):
        words, kept = text.split(), iter([*left[i].split(), None])
        at, cut = next(kept), []
        for w in words:  # words are distinct within a text
            cut.append(w != at)
            at = at if cut[-1] else next(kept)
        assert at is None
        assert all(n for n, c in zip(narrow, cut) if c)
        assert sum(w and not c for w, c in zip(wide, cut)) <= 40
        assert sum(wide) == 0 or sum(cut) >= sum(wide) / 2


def test_a_given_cut_chars_is_replaced(spark):
    text = "One long sentence stands here with many words. Another long one follows it at once."
    docs = spark.createDataFrame([(1, text, "x"), (2, text, "x")], "doc_id long, text string, cut_chars string")
    out = {r["doc_id"]: r["cut_chars"] for r in repeats.remove_repeats(docs).collect()}
    assert out == {1: 0, 2: len(text)}
