import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import PLAIN, SPACED, by_key, documents, lower, prose, texts

from labelforge.llm import decontaminate, licenses, line_dedup, quality, url_templates
from labelforge.llm.words import slices


def base_counts(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(k, k + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def test_base_rules_against_brute_force(spark):
    rows = texts() + [(900, "a\n\na\n a\n#*$ <|>& %\n"), (901, "\n".join(["x y"] * 30))]
    docs = documents(spark, rows).drop("n_words", "kept")
    got = [r.asDict() for r in quality.judge(docs).collect()]
    keys = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert by_key(got, *keys) == by_key([{"doc_id": i} | base_counts(t) for i, t in rows], *keys)
    assert all(not r["kept"] for r in got if r["base_failed"])


def mcd(points, share):
    """Squared distances of one group by the same rule, row by row: the kept
    half is chosen by cells of rows, of three starts the least determinant wins."""
    x = np.array(points, np.int64)
    floors = np.array(quality.FLOORS)
    m = np.floor(np.median(x, 0))
    d = (x - m) / quality.GRID
    spread = np.maximum(np.median(np.abs(x - m), 0) * 1.4826 / quality.GRID, floors)
    cell = [tuple(r) for r in np.clip(np.floor(np.abs(d / (0.25 * spread)) + 0.5) * np.sign(d), -12, 12).astype(int)]
    members = {c: [i for i, own in enumerate(cell) if own == c] for c in sorted(set(cell))}
    regular = lambda w: 2.11 * np.cov(d.T, aweights=w, ddof=0) + np.diag(floors**2)
    fullest = max(members, key=lambda c: (len(members[c]), [-v for v in c]))
    found = []
    for mean, cov in ((np.zeros(4), np.diag(spread**2)), (d[members[fullest]].mean(0), np.diag(spread**2)),
                      (d.mean(0), np.cov(d.T, ddof=0) + np.diag(floors**2))):
        best = np.inf
        while True:
            far = np.einsum("ni,ij,nj->n", d - mean, np.linalg.inv(cov), d - mean)
            ranked = sorted(members, key=lambda c: (far[members[c]].mean(), c))
            left, weight = share * len(x), np.zeros(len(x))
            for c in ranked:
                weight[members[c]] = max(0.0, min(1.0, left / len(members[c])))
                left -= len(members[c])
            next_cov = regular(weight)
            log_det = np.linalg.slogdet(next_cov)[1]
            if log_det >= best - 1e-9:
                break
            best, mean, cov = log_det, weight @ d / weight.sum(), next_cov
        found.append((best, mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    return np.einsum("ni,ij,nj->n", d - mean, np.linalg.inv(cov), d - mean)


def grid_of(r):
    g = [min((r["word_chars"] + 250) / (r["n_words"] + 50), 64), (r["n_symbols"] / (r["word_chars"] + 250)) ** 0.5,
         (r["n_dup_lines"] / (r["n_lines"] + 10)) ** 0.5, (r["n_repeat_words"] / (r["n_words"] + 200)) ** 0.5]
    return [int(np.floor(v * quality.GRID + 0.5)) for v in g]


def test_distances_against_numpy(spark):
    """Every group by its own estimate, small ones pooled by language, and
    those that are still too few all together."""
    rng = random.Random(4)
    groups = {("en", "big"): 120, ("en", "a"): 20, ("en", None): 35, ("fr", "a"): 10, (None, "a"): 15, ("de", "x"): 60, (None, None): 2}
    rows = []
    for (lang, source), n in groups.items():
        for _ in range(n):
            text = prose(rng, rng.randint(20, 200)) + " ### $$$ %%%" * (rng.random() < 0.3) + "\none line\none line" * (rng.random() < 0.3)
            rows.append((len(rows), text + " " + "w" * 30_000 if len(rows) == 7 else text, lang, source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    got = quality.judge(docs, keep=("doc_id", "lang", "source")).collect()
    pooled = {}
    for r in got:
        n = groups[r["lang"], r["source"]]
        small = sum(m for (lang, _), m in groups.items() if lang == r["lang"] and m < quality.MIN_GROUP)
        name = (r["lang"], r["source"]) if n >= quality.MIN_GROUP else ("language", r["lang"]) if small >= quality.MIN_GROUP else "rest"
        pooled.setdefault(name, []).append(r)
    assert set(pooled) == {("en", "big"), ("language", "en"), ("de", "x"), "rest"}
    for members in pooled.values():
        want = mcd([grid_of(r) for r in members], quality.KEPT_SHARE)
        assert np.allclose([r["distance"] for r in members], want, rtol=1e-6)
        assert [r["kept"] for r in members] == [w <= quality.CUTOFF for w in want]


def test_determinants_fall_and_the_least_wins():
    """Concentration steps on cells of many shapes come to rest."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        n = rng.integers(1, 1000 if trial % 2 else 3, 400).astype(float)
        at = np.concatenate([rng.normal(0, 1, (200, 4)), rng.normal(rng.normal(0, 4, 4), 0.3, (200, 4))])
        s, q = at * n[:, None], np.einsum("ci,cj->cij", at, at) * n[:, None, None]
        spread = np.maximum(np.abs(at).mean(0), quality.FLOORS)
        least = quality.least_determinant(n, s, q, spread, quality.FLOORS, 0.5)
        for mean, cov in ((np.zeros(4), np.diag(spread**2)), (at[7], np.eye(4) * 0.01), (at.mean(0), np.eye(4) * 50)):
            log_det, _, _, steps = quality.concentrate(n, s, q, mean, cov, quality.FLOORS, 0.5)
            assert np.isfinite(log_det) and steps < 400
        assert least[0] <= quality.concentrate(n, s, q, np.zeros(4), np.diag(spread**2), quality.FLOORS, 0.5)[0]


def test_rejected_rows_go_and_columns_stay(spark):
    """Whatever the columns are called, texts, nulls and repeated rows stay as they are."""
    from pyspark.sql import functions as F

    names = ("kept", "distance", "n_words", "n_lines", "n_dropped", "base_failed", "__key", "__text", "__h", "cell", "n", "word_chars")
    docs = documents(spark, extra=False).withColumns({c: F.lit("own") for c in names})
    out = quality.drop_rejected(docs)
    assert out.columns == docs.columns
    verdicts = {(r["text"], r["lang"], r["source"]): r["kept"] for r in quality.judge(docs.drop(*names), keep=("text", "lang", "source")).collect()}
    want = [r for r in docs.collect() if verdicts[r["text"], r["lang"], r["source"]]]
    assert sorted(map(str, out.collect())) == sorted(map(str, want)) and 0 < len(want) < docs.count()
    assert quality.drop_rejected(docs.limit(0)).collect() == []


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    clean = [(i, prose(rng, rng.randint(25, 400))) for i in range(150)]
    junk = [(1000 + i, " ".join(w + "$$$%%%" for w in prose(rng, 80).split())) for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, clean + junk).drop("kept", "n_words")).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_junk_of_nearly_half_a_group_goes(spark):
    """A bad source, and one junk text copied until it fills a third of its group."""
    rng = random.Random(12)
    junk = lambda: " ".join(w + "$$$%%%" for w in prose(rng, 80).split())
    copied = junk()
    rows = [(i, prose(rng, rng.randint(25, 400)), "bad") for i in range(150)] + [(1000 + i, junk(), "bad") for i in range(100)]
    rows += [(2000 + i, prose(rng, rng.randint(25, 400)), "copies") for i in range(150)] + [(3000 + i, copied, "copies") for i in range(75)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "'en' lang", "source")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert got == {i: i // 1000 % 2 == 0 for i, _, _ in rows}


def test_text_can_be_kept(spark):
    docs = documents(spark, extra=False)
    a = quality.judge(docs).select("doc_id", "kept", "n_words")
    b = quality.judge(docs, keep=tuple(docs.columns))
    assert by_key(a.collect(), "doc_id", "n_words", "kept") == by_key(b.collect(), "doc_id", "n_words", "kept")
    assert by_key(b.collect(), "doc_id", "text") == by_key([{"doc_id": i, "text": t} for i, t in texts()], "doc_id", "text")


def test_quality_of_nothing(spark):
    none = documents(spark, [], extra=False)
    assert quality.judge(none).collect() == []
    only = documents(spark, [(1, None), (2, ""), (3, "few words")], extra=False)
    assert {(r["doc_id"], r["kept"], r["distance"]) for r in quality.judge(only).collect()} == {(1, False, None), (2, False, None), (3, False, None)}
    with pytest.raises(ValueError, match="overwritten"):
        quality.count_rules(documents(spark), keep=("doc_id", "n_words"))


def phrase_places(text):
    w = PLAIN.findall(lower(text))
    return len(w), sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def test_phrases_against_brute_force(spark):
    rows = texts() + [(500, "Released under the MIT License. mit-license MIT\nLicense the mitlicense mit licenses"), (501, "MIT LICENSE"),
                      (502, "GNU General Public\tLicense, apache license apache license"), (503, "mit"), (504, "license mit"), (505, "mít license é mit license")]
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], sorted((s["first_word"], s["label"]) for s in r["spans"] if s["base"])))
    for i, t in rows:
        assert phrase_places(t) in got[i]


def test_notices_with_few_edits_are_found_and_others_not(spark):
    rng = random.Random(2)
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    edits = {1: notice, 2: notice.replace("hereby", "herby").replace("charge", "chargee"), 3: notice.upper().replace(" ", ",\n"),
             4: "x" + notice[3:-2], 5: "permission is granted to sell a copy free to any person", 6: notice.replace("granted free of", "")}
    rows = [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, t in edits.items()] + [(7, notice), (8, notice[:30]), (9, None)]
    got = {r["doc_id"]: [(s["label"], s["edits"], s["first_word"], s["last_word"]) for s in r["spans"] if not s["base"]]
           for r in licenses.scan(documents(spark, rows)).collect()}
    n = len(notice.split())
    assert [g[0] for g in got[1]] == ["mit"] and got[1][0][1] == 0
    assert got[7] == [("mit", 0, 0, n - 1)]
    assert got[2][0][:2] == ("mit", 2) and got[3][0][:2] == ("mit", 0) and got[4][0][0] == "mit"
    assert got[5] == got[6] == got[8] == got[9] == []


def test_fuzzy_search_misses_nothing():
    """Every span with at most k edits, found by trying all places of short texts."""
    import regex

    rng = random.Random(8)
    notice = licenses.Notice("alpha beta gamma delta", "x", 7)
    alone = regex.compile(f"(?:{notice.text}){{e<={notice.edits}}}")
    for _ in range(300):
        raw = list(notice.text)
        for _ in range(rng.randint(0, 5)):
            raw[rng.randrange(len(raw))] = rng.choice(["", "q", " ", "zz"])
        text = f"{prose(rng, 3)} {''.join(raw)} {prose(rng, 3)}"
        _, data, begins = next(slices(pa.array([text])))
        plain = licenses.Plain(data, begins)
        found = licenses.find_spans(plain, [notice], [])[0]
        assert bool(found) == bool(alone.search(plain.raw.decode().strip("\n"))), text


def spans_of(text, notice):
    _, data, begins = next(slices(pa.array([text])))
    return licenses.find_spans(licenses.Plain(data, begins), [notice], [])[0]


def distance(x, y):
    """Edits between two strings."""
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_neighbouring_notices_are_all_found():
    """The better of two does not hide the other, whichever comes first."""
    notice = licenses.Notice("released under the mit license", "mit", 12)
    for text, n in (("releazed undr the mit license released under the mit license end", 2), ("released under the mit license releazed undr the mit license", 2),
                    ("releazed undr the mit license released under the mit license releaseed under the mit licens", 3),
                    (" ".join(["released under the mit license"] * 40), 40), ("released under the mit " * 3 + "license", 1)):
        spans = spans_of(text, notice)
        assert len(spans) == n, text
        assert all(a["last_word"] < b["first_word"] for a, b in zip(spans, spans[1:], strict=False))


def test_spans_and_edits_of_planted_notices(spark):
    """Each planted notice has one span, around its words, with no more edits
    than were made, and its label and score."""
    rng = random.Random(17)
    notices = {"alpha beta gamma delta epsilon zeta eta theta": "greek", "permission is hereby granted free of charge": "mit"}
    rows, want = [], {}
    for i in range(150):
        words, planted = prose(rng, rng.randint(0, 8)).split(), []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice(list(notices))
            raw = list(text)
            edits = rng.randint(0, len(text) // 12)
            for _ in range(edits):
                at = rng.randrange(1, len(raw) - 1)
                raw[at] = rng.choice(["", "q", raw[at] + "q"]) if raw[at] != " " else " "
            new = "".join(raw).split()
            planted.append((notices[text], len(words), len(words) + len(new) - 1, distance("".join(raw), text), len(text)))
            words += new + prose(rng, rng.randint(3, 9)).split()
        rows.append((i, " ".join(words)))
        want[i] = planted
    table = spark.createDataFrame([(t.upper().replace(" ", ", "), label) for t, label in notices.items()] + [(None, "x"), ("?!", "y"), ("z", None)], "text string, label string")
    got = {r["doc_id"]: [s for s in r["spans"] if not s["base"]] for r in licenses.scan(documents(spark, rows), table).collect()}
    for i, planted in want.items():
        assert len(got[i]) == len(planted), rows[i]
        for label, _, _, edits, size in planted:
            assert any(s["label"] == label and s["edits"] <= edits and s["score"] == 1 - s["edits"] / size for s in got[i])


def test_repeats_of_a_part_take_no_time():
    import time

    notice = licenses.Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 12)
    begun = time.time()
    assert spans_of("granted free of charge " * 4000, notice) == []
    found = spans_of("granted free of charge " * 2000 + notice.text + " granted free of charge" * 2000, notice)
    assert [(s["first_word"], s["edits"]) for s in found] == [(8000, 0)]
    assert time.time() - begun < 5


def test_too_many_notices(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_NOTICES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        licenses.scan(documents(spark), spark.createDataFrame([("a b", "x"), ("c d", "y")], "text string, label string"))


def contaminated(rows, items, window):
    runs = {}
    for i, t in items:
        w = PLAIN.findall(lower(t))
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            runs.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    lengths = {len(r) for r in runs}
    out = []
    for i, t in rows:
        w = PLAIN.findall(lower(t))
        hit, found = set(), set()
        for size in lengths:
            for k in range(len(w) - size + 1):
                if own := runs.get(tuple(w[k : k + size])):
                    found |= own
                    hit.update(range(k, k + size))
        out.append({"doc_id": i, "n_words": len(w), "n_hit": len(hit), "items": sorted(found)})
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    given = dict(texts()[:12])
    items = [(i, prose(rng, rng.randint(10, 40))) for i in range(6)]
    items += [(20, " ".join(given[1].split()[40:75])), (21, " ".join(given[1].split()[60:90]).upper()), (22, "two words"), (23, "one"), (24, ""), (25, None),
              (26, "a b c"), (27, items[0][1]), (None, items[1][1]), (28, "same same same same same same same same same same")]
    rows = texts() + [(600 + i, f"{prose(rng, 20)} {t} {prose(rng, 5)}") for i, (_, t) in enumerate(items[:6])]
    rows += [(700, items[0][1][:-3]), (701, items[2][1] + " " + items[3][1]), (702, "Two, WORDS!")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    keys = "doc_id", "n_words", "n_hit", "items"
    for window, shingle in ((10, 3), (4, 1), (6, 6)):
        got = decontaminate.contamination(documents(spark, rows), table, window, shingle).collect()
        assert by_key(got, *keys) == by_key(contaminated(rows, items, window), *keys), (window, shingle)
        for r in got:
            assert sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]) == r["n_hit"]


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(documents(spark), items).collect())
    assert decontaminate.contamination(documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect() == []


def by_rules(url):
    parts = (url or "").split("://", 1)
    rest = parts[1] if len(parts) == 2 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = lower(host)
    fits = [r for r in url_templates.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id bigint, url string, html string, host string")


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "http://", "https://COM/x", "http://a.com", "http://a.com/", "http://Example.COM/en/1?q#f", "http://www.example.com/en/",
            "http://x.www.example.com/en/?a", "http://www.example.com/EN/", "http://b.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://b.net/fr#x",
            "a://b://c/d", "http://h?x/y", "http://h#x", "http://É.com/é", "http://u:p@h.net:80/es/", "http://x.net/es", "http://a\nb.com/c\nd?e"]
    got = url_templates.judge_urls(pages_table(spark, list(enumerate(urls)) + [(None, urls[11])]), spark.createDataFrame([], "page_id bigint, bad int")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = by_rules(urls[11 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")


def test_bad_templates_are_rejected(spark):
    rows, labels = [], []
    for i in range(400):
        kind = ("news", "spam", "shop")[i % 3]
        rows.append((i, f"http://a.org/{kind}/{i}/x" if i % 2 else f"http://a.org/{kind}/item-{i}.html"))
        if i % 4 < 2:
            labels.append((i, int(kind == "spam")))
    got = url_templates.judge_urls(pages_table(spark, rows), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert all((r["verdict"] == "block") == ("/spam/" in r["path"]) for r in got)
    assert len({r["template"] for r in got}) <= 6


def test_rules_do_not_speak_for_labels(spark):
    """Pages that rules block lie beside labelled ones: only templates whose own
    labelled pages are bad are rejected."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(["es", "fr", "en", "de", "bad"])
        rows.append((i, f"http://m.site.net/{lang}/{i}"))
        share = {"en": 0.3, "de": 0.1, "bad": 0.95}.get(lang, 0.0)
        if rng.random() < 0.7:
            labels.append((i, int(rng.random() < share)))
    bad = dict(labels)
    got = url_templates.judge_urls(pages_table(spark, rows), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert all((r["rule"] is not None, r["template"], r["bad_share"]) == (True, None, None) for r in got if r["path"][:4] in ("/es/", "/fr/"))
    free = [r for r in got if r["rule"] is None]
    whole = [bad[r["page_id"]] for r in free if r["page_id"] in bad]
    prior = sum(whole) / len(whole)
    host = (sum(whole) + url_templates.SMOOTH * prior) / (len(whole) + url_templates.SMOOTH)
    for template in {r["template"] for r in free}:
        own = [r for r in free if r["template"] == template]
        known = [bad[r["page_id"]] for r in own if r["page_id"] in bad]
        share = (sum(known) + url_templates.SMOOTH * host) / (len(known) + url_templates.SMOOTH)
        assert all(abs(r["bad_share"] - share) < 1e-12 and r["verdict"] == ("block" if share > url_templates.REJECT else "allow") for r in own)
    assert {r["path"].split("/")[1] for r in free if r["verdict"] == "block"} == {"bad"}


def test_very_long_urls(spark):
    rows = [(1, "http://a.org/" + "x/" * 20_000 + "7"), (2, "http://" + "h" * 50_000 + "/p"), (3, "://" * 9_000), (4, "a" * 70_000)]
    got = {r["page_id"]: r for r in url_templates.judge_urls(pages_table(spark, rows), spark.createDataFrame([], "page_id bigint, bad int")).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == dict.fromkeys(range(1, 5), "allow")
    assert got[1]["path"] == "/" + "x/" * 20_000 + "7" and got[2]["host"] == "h" * 50_000 and got[4]["host"] == ""


def test_many_rare_branches_become_one_template(spark):
    rows = [(i, f"http://b.org/user/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/home") for i in range(200)] + [(900 + i, "http://b.org/user/admin/home") for i in range(60)]
    got = url_templates.judge_urls(pages_table(spark, rows), spark.createDataFrame([(3, 1)], "page_id bigint, bad int")).collect()
    assert len({r["template"] for r in got}) <= 2
    assert url_templates.judge_urls(pages_table(spark, []).limit(0), spark.createDataFrame([], "page_id bigint, bad int")).collect() == []


def templates(rows, min_docs):
    """Lines to drop, by the documented rules in plain Python."""
    lines = [(i, t, n, SPACED.findall(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    mask = lambda x: re.sub("[0-9]+", "#", x)
    leaf = lambda w: (len(w), tuple(map(mask, w[:3])))
    held = Counter(leaf(x[3]) for x in lines)
    tokens = Counter((leaf(w), k, t) for _, _, _, w in lines for k, t in enumerate(w))

    def level(w, k):
        """The first level at which a token is constant, if any."""
        c, n = tokens[leaf(w), k, w[k]], held[leaf(w)]
        if c < min_docs:
            return None
        return 3 if re.search("[0-9]", w[k]) else 0 if c >= 0.5 * n else 1 if c >= 0.25 * n else 2

    named = []
    for i, t, n, w in lines:
        if held[leaf(w)] >= min_docs:
            levels = [level(w, k) for k in range(len(w))]
            known = sorted(x for x in levels if x is not None)
            need = -(-len(w) * 6 // 10)
            if len(known) >= need:
                parts = tuple(x if own is not None and own <= known[need - 1] else "<*>" for x, own in zip(w, levels, strict=True))
                named.append((i, t, n, (leaf(w), parts), min_docs))
        if sum(not re.search("[0-9]", x) for x in w) >= 20:
            named.append((i, t, n, tuple(map(mask, w)), 2))
    spread, first = {}, {}
    for i, t, n, key, _ in named:
        spread.setdefault(key, set()).add(t)
        at = (i is None, i or 0, n)
        first[key] = min(first.get(key, at), at)
    return {(i, t, n) for i, t, n, key, need in named if len(spread[key]) >= need and first[key] != (i is None, i or 0, n)}


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    rows = list(texts())
    for i in range(40):
        rows.append((800 + i, "\n".join([prose(rng, 6), "Click here to read more", f"Posted on day {i} by user{i % 9} in news", "", prose(rng, 3),
                                         *(["Click here to read more"] if i % 5 == 0 else []), f"random {i} words", "   "])))
    rows += [(850, rows[-1][1]), (800, rows[len(texts())][1])]
    # fields of few values, and a line that holds little of its leaf
    rows += [(1000 + i, "\n".join(stamped(rng, 2) + [f"Last updated on {prose(rng, 19)}"])) for i in range(60)]
    # long lines that recur in two documents, with other numbers, or in one only
    for i in range(8):
        passage = prose(rng, 30)
        rows += [(1100 + 4 * i + k, f"{prose(rng, 4)}\n{re.sub('[0-9]+', lambda m: str(rng.randint(0, 9)), passage)}\n{prose(rng, 25)}") for k in range(1 + i % 3)]
    long = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(21))
    rows += [(1200, long), (1201, f"x\n{long}"), (1202, long + " one more"), (1203, long[:-12]), (1204, f"y\n{long[:-12]}"), (None, f"z\n{long}")]
    gone = templates(rows, 10)
    assert {(1201, 1), (None, 1)} <= {(i, n) for i, _, n in gone} and not any(i in (1200, 1202, 1203, 1204) for i, _, _ in gone)
    want = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)
        want.append({"doc_id": i, "text": kept, "n_lines": 0 if t is None else t.count("\n") + 1, "n_dropped": sum((i, t, n) in gone for n in range((t or "").count("\n") + 1))})
    docs = documents(spark, rows)
    out = line_dedup.drop_lines(docs, min_docs=10)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    keys = "doc_id", "text", "n_lines", "n_dropped"
    assert by_key(out.collect(), *keys) == by_key(want, *keys)
    assert sum(w["n_dropped"] for w in want) > 70


def test_lines_of_nothing(spark):
    assert line_dedup.drop_lines(documents(spark, [])).collect() == []


def test_long_text_is_split_once(spark):
    """Splitting the text again for every line that stays took minutes here."""
    long = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(21))
    lines = [f"own line {'x' * (i % 7)} {i}" for i in range(40_000)]
    began = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(documents(spark, [(1, long), (2, "\n".join([*lines[:5], long, *lines[5:]]))]), min_docs=10**6).collect()}
    assert time.monotonic() - began < 40
    assert got[1]["text"] == long and got[2]["text"] == "\n".join(lines) and (got[2]["n_lines"], got[2]["n_dropped"]) == (40_001, 1)


def test_white_space_of_lines(spark):
    """Tokens stand between any ASCII white space; the text itself is not changed."""
    long = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(21))
    rows = [(1, long), (2, "a\tb\r\n" + long.replace(" ", "\t\x0b \x0c", 9) + "\r\n\x0b\n c\x1c"), (3, "\r" + long.replace(" ", "\xa0", 1) + "\t")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(documents(spark, rows)).collect()}
    assert got == {1: (long, 1, 0), 2: ("a\tb\r\n\x0b\n c\x1c", 4, 1), 3: (rows[2][1], 1, 0)}


def dropped(spark, lines, **limits):
    """How many lines go when each is a document of its own."""
    out = line_dedup.drop_lines(documents(spark, list(enumerate(lines))), **limits)
    return sum(r["n_dropped"] for r in out.select("n_dropped").collect())


def stamped(rng, n):
    return [f"Last updated on {rng.randint(1, 28)} / {rng.randint(1, 12)} at {rng.randint(0, 23)} : {rng.randint(0, 59)} by the editor "
            f"user{rng.randint(1, 200)} for all our readers" for _ in range(n)]


def test_a_template_is_one_at_every_size(spark):
    """Fields of few values, however many lines hold each value."""
    rng = random.Random(3)
    for n in (50, 200, 3000):
        lines = sorted(set(stamped(rng, n)))
        assert dropped(spark, lines) == len(lines) - 1, n
    days, places, moods = "Mon Tue Wed Thu Fri Sat Sun".split(), "Rome Oslo Bern Kyiv Lima".split(), "glad calm sad".split()
    named = [f"Sent to you on a {rng.choice(days)} from our office in {rng.choice(places)} by a {rng.choice(moods)} person called n{i}" for i in range(2000)]
    assert dropped(spark, named) == len(named) - 1


def test_a_template_is_found_beside_others_of_its_leaf(spark):
    """Templates that hold little of a leaf, with numbers as fields, and lines
    that recur as they are; other lines of the leaf stay."""
    rng = random.Random(6)
    other = [f"Last updated on {' '.join(f'{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}' for k in range(15))}" for i in range(4000)]
    same = [f"{'Last updated on ' + 'this very day by all of the many people that ever wrote here'} gone\nown{i}x" for i in range(40)]
    lines = sorted(set(stamped(rng, 600)))
    assert dropped(spark, other) == 0
    assert dropped(spark, other + lines) == len(lines) - 1
    assert dropped(spark, other + same) == len(same) - 1
    numbers = [f"{i} | {i * 7} | {i * 13} | {i * 17}" for i in range(1000)]
    assert dropped(spark, numbers) == 0
