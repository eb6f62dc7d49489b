import random

from llm.helpers import LETTERED, by_id, lower, rows

from quarry.llm import license_scan as L


def words(t):
    return LETTERED.findall(lower(t))


def brute(t):
    w, at, labels = words(t), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(df):
    got = rows(L.license_notices(df))
    texts = sorted((brute(r.text) for r in df.collect()), key=str)
    assert sorted(((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == texts
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and (not r["n_base"] or r["score"] == 1)


def test_base_equals_brute_force(tiny, edge, empty):
    check(tiny)
    check(edge)
    assert L.license_notices(empty).count() == 0


def edit(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + rng.choice("abcxyz") + s[i + 1:], s[:i] + s[i + 1:], s[:i] + rng.choice("abcxyz") + s[i:]])
    return s


def test_every_notice_within_its_edits_is_found(spark):
    """Pigeonhole seeds lose nothing: a match has an unchanged piece. Compared with a search without seeds."""
    import regex
    rng = random.Random(4)
    docs, want = [], {}
    for notice, label in L.NOTICES.items():
        for k in range(L.edits_for(notice) + 1):
            for _ in range(6):
                n = len(docs)
                text = edit(rng, notice, k)
                docs.append((n, f"Lorem ipsum, {text.upper()}; dolor sit.\nAmet"))
                got = " ".join(words(docs[-1][1]))
                m = regex.search(r"(?<![^ ])(?:" + notice + r"){e<=%d}(?![^ ])" % L.edits_for(notice), got)
                want[n] = label if m else None
    r = by_id(L.license_notices(spark.createDataFrame(docs, "doc_id long, text string")))
    missed = [n for n, label in want.items() if label and label not in r[n]["labels"].split(",")]
    assert len([x for x in want.values() if x]) > 200 and not missed


def test_clean_texts_have_no_labels(spark):
    docs = [(1, "under the bridge a limit was licensed"), (2, "cc by"), (3, "mit license"), (4, "the public likes general gnus"),
            (5, "under the mit"), (6, "license cc\nby nc"), (7, "Under-the MIT (license)")]
    r = by_id(L.license_notices(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [r[i]["labels"] for i in range(1, 6)] == [""] * 5
    assert r[6]["labels"] == "cc-by-nc" and r[7]["base_labels"] == "mit" and r[7]["first_word"] == 0
