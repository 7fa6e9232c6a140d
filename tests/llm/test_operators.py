"""Each operator against a brute-force twin, on awkward rows and on empty tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import decontamination, language_id, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, suffix_dedup, url_reputation
from parlance.llm.queries import tokenizer_path
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


def pairs():
    return [(r[0], r[1]) for r in fx.rows()]


def many(rows):
    return collections.Counter(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_ANCHORS, 2])
def test_suffix_dedup(docs, hot):
    found = suffix_dedup.remove_repeats(docs, length=200, hot_anchors=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, *x) for (i, _), x in zip(pairs(), fx.repeats([t for _, t in pairs()], 200), strict=True)]
    assert many(found) == many(want)


def test_merge_runs_keeps_order_and_prefixes():
    r = np.random.default_rng(3)
    runs = [sorted(bytes(r.integers(0, 3, r.integers(0, 30), dtype=np.uint8)) for _ in range(r.integers(0, 40))) for _ in range(7)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.front_code([(s, b"", 0) for s in run]) for run in runs]))
    suffixes = [m[1] for m in merged]
    assert suffixes == sorted(x for run in runs for x in run)
    for before, after in zip(merged[:-1], merged[1:], strict=True):
        assert after[0] == suffix_dedup.common_prefix(before[1], after[1])
    assert all(runs[m[4]][m[5]] == m[1] for m in merged)


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 768), (5, 80, 768), (3, 90, 4)])
def test_ngram_join(docs, width, percent, block):
    found = ngram_join.jaccard_components(docs, width=width, percent=percent, block_rows=block).collect()
    want = fx.components(pairs(), width, percent)
    assert len(found) == len(fx.rows())
    for r in found:
        assert r["n_shingles"] == len(fx.shingles(dict(pairs()).get(r["doc_id"], fx.texts()[9]), width))
        assert r["component_id"] == want.get(r["doc_id"])


@pytest.mark.parametrize("block", [768, 4])
def test_ngram_join_of_ids_with_several_texts(spark, block):
    r = np.random.default_rng(4)
    rows = []
    for k in range(0, 160, 10):  # the first two share an id, and each of them has a partner that is too far from the other
        w = [f"w{x}" for x in r.integers(0, 10**6, 120)]
        rows += [(k + 9, w), (k + 9, ["zz", *w[8:]]), (k + 5, ["zz", "zz", *w[16:]]), (k + 3, [*w[:-8], "yy"])]
    one, two, three = ([f"w{x}" for x in r.integers(0, 10**6, 60)] for _ in range(3))
    rows += [(301, one), (300, one), (301, two), (400, three)]  # the class of ``one`` stands for 300, that of ``two`` for 301
    rows = [(i, " ".join(w)) for i, w in rows]
    keys = list(range(len(rows)))
    parent = fx.components([(k, x) for k, (_, x) in zip(keys, rows, strict=True)], 3, 90)
    group = [parent[k] for k in keys]
    for _ in rows:  # rows that share an id, too
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                if a == b and group[i] != group[j]:
                    group = [min(group[i], group[j]) if g == max(group[i], group[j]) else g for g in group]
    want = [(i, min(rows[j][0] for j in keys if group[j] == group[k])) for k, (i, _) in zip(keys, rows, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.jaccard_components(docs, width=3, percent=90, block_rows=block).select("doc_id", "component_id").collect()
    assert many(found) == many(want)


def test_dense_product_agrees_with_pairs():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    forest = ngram_join.linked_pairs(sets, [0] * 40, 60)
    whole = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert set(forest) <= whole
    label = list(range(40))
    for edges in (whole,):
        for i, j in edges:
            label = [label[i] if x == label[j] else x for x in label]
    own = list(range(40))
    for i, j in forest:
        own = [own[i] if x == own[j] else x for x in own]
    assert all((label[i] == label[j]) == (own[i] == own[j]) for i in range(40) for j in range(40))


@pytest.mark.parametrize("most_prints", [1 << 20, 3])
def test_decontamination(spark, docs, most_prints):
    t = fx.texts()
    items = [(1, " ".join(t[8].split()[20:45])), (2, "One TWO"), (3, None), (None, "one"), (4, t[30]), (5, "nowhere to be found at all in any of these short texts")]
    found = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), most_prints=most_prints)
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(fx.LOWER))
    windows = collections.defaultdict(set)
    for i, x in items:
        w = words(x)
        k = min(10, len(w))
        if k and i is not None:
            for s in range(len(w) - k + 1):
                windows[tuple(w[s : s + k])].add(str(i))
    want = []
    for i, x in pairs():
        w, hit, own = words(x), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    own |= owners
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    assert many(found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == many(want)
    assert sum(x[5] for x in want) > 5


def test_line_dedup(spark, docs):
    keys = lambda x: [y.strip(" \t\n\x0b\x0c\r").translate(fx.LOWER) for y in (x or "").split("\n")]
    counts = collections.Counter(k for _, x in pairs() for k in set(keys(x)) if k)
    want = []
    for i, x in pairs():
        lines = (x or "").split("\n")
        kept = [y for y, k in zip(lines, keys(x), strict=True) if counts[k] < 10]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    found = line_dedup.drop_common_lines(docs, min_docs=10, batches=6).select("doc_id", "n_lines", "n_dropped", "sha").collect()
    assert many(found) == many(want)
    assert sum(x[2] for x in want) >= 20


def test_line_dedup_of_longer_keys(spark):
    rows = [(i, t) for i in range(3) for t in ("ab\nüü\nabc",)]
    found = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, min_chars=3, batches=2).select("doc_id", "text", "n_dropped")
    assert many(found.collect()) == many((i, "ab\nüü", 1) for i in range(3))


def test_line_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, buckets=3, min_docs=3, fanout=2)
    batch = lambda *x: spark.createDataFrame([(k.encode(), 1) for k in x], "key binary, n long")
    for keys in ("abx", "bcx", "cdx", "bex"):
        runs.add(batch(*keys))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {(r["key"], r["n"]) for r in runs.runs()[0].collect()} == {(b"a", 1), (b"b", 3), (b"c", 2), (b"d", 1), (b"e", 1), (b"x", 3)}
    assert {r["key"] for r in runs.common_keys().collect()} == {b"b", b"x"}
    assert [r["key"] for r in runs.unseen(batch("a", "z")).collect()] == [b"z"]
    assert {(r["key"], r["n"]) for r in runs.not_common(batch("b", "c", "z")).collect()} == {(b"c", 3), (b"z", 1)}
    runs.forget()


def test_line_runs_move_no_rows_after_the_first_exchange(spark):
    runs = line_dedup.LineRuns(spark, buckets=3, min_docs=3, fanout=8)
    counts = spark.table(runs.bucketed(spark.createDataFrame([(b"a", 1), (b"b", 2)], "key binary, n long"), "counts"))
    runs.add(counts)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = runs.not_common(counts)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.forget()


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    found = packing.pack_documents(docs, tokenizer_path(), max_length=256).toPandas()
    want = collections.Counter()
    for i, x in pairs():
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            want[str(i), s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = collections.Counter(zip(found.doc_id.map(lambda x: "None" if x != x else str(int(x))), found.start, found.length, found.ids_crc32, found.doc_tokens, strict=True))
    assert got == want
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 256
    padding = 256 * found.sequence_id.nunique() - found.length.sum()
    assert padding < 0.05 * found.length.sum() + 256


def test_quality_rules(docs):
    want = []
    for i, x in pairs():
        w = re.findall("[^\x20\x09-\x0d]+", x or "")
        places = collections.defaultdict(list)
        for s in range(len(w) - 4):
            places[tuple(w[s : s + 5])].append(s)
        repeated = {s + k for p in places.values() if len(p) > 1 for s in p for k in range(5)}
        lines = [y for y in (x or "").split("\n") if re.search("[^\x20\x09-\x0d]", y)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)))
    found = quality_rules.apply_quality_rules(docs).drop("kept").collect()
    assert many(found) == many(want)


def test_cascade_order_never_changes_the_verdict(docs):
    stats = quality_rules.text_statistics(docs)
    rules = [quality_rules.base_rule(), *quality_rules.default_rules()]
    planned = quality_rules.plan_cascade(docs, rules)
    assert {r.name for r in planned} == {r.name for r in rules}
    one, two = (quality_rules.first_rejection(x).isNull() for x in (planned, rules[::-1]))
    assert stats.where(one != two).count() == 0


def test_language_id(spark):
    base = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(base)
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify_languages(docs, model).join(docs.where(held_out & (F.length("text") > 100)).select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 !!"), (3, "漢字")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify_languages(odd, model).collect()][:3] == ["und"] * 3


def test_language_id_knows_every_letter_of_the_sample():
    r = np.random.default_rng(11)
    alphabets = {"ar": (0x627, 28), "el": (0x3B1, 17), "en": (0x61, 26), "ja": (0x3041, 80), "ru": (0x430, 32), "zh": (0x4E00, 600)}
    words = {k: ["".join(chr(first + c) for c in r.integers(0, n, 4)) for _ in range(150)] for k, (first, n) in alphabets.items()}
    said = lambda k, n: " ".join(words[k][i] for i in r.integers(0, 150, n))
    texts = {k: said(k, 600 if k == "en" else 200) for k in alphabets}
    model = language_id.LanguageModel(texts)
    tests = [said(k, 12) for k in alphabets] + ["漢 \u9fa0", said("zh", 3) + " \u9fa0 " + said("en", 3)]

    def phrases(text, known):
        count, held = 1, ""
        for c in text:
            if held + c not in known:
                count, held = count + 1, ""
                c = c if c in known else ""
            held += c
        return count

    assert model.phrases([model.classes(t) for t in tests]).tolist() == [[phrases(t, texts[k]) for k in model.names] for t in tests]
    found = model.predict(tests[: len(alphabets)])
    assert [x[0] for x in found] == list(alphabets) and all(x[1] > 0 for x in found)


def test_suffix_automaton_knows_exactly_the_substrings():
    text = np.array([1, 2, 1, 2, 2, 1])
    table = language_id.suffix_automaton(text, 3)
    inside = {tuple(text[i:j]) for i in range(6) for j in range(i + 1, 7)}
    for n in range(1, 5):
        for word in np.ndindex(*[2] * n):
            state = 0
            for c in word:
                state = table[state, c + 1] if state >= 0 else -1
            assert (state >= 0) == (tuple(c + 1 for c in word) in inside)


def test_personal_data(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]

    found = pii.find_personal_data(docs).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()
    want = []
    for i, x in pairs():
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, x or "") if good(k, m.group()))
        want.append((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))
    assert many((r["doc_id"], r["base"]) for r in found) == many(want)
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in found)


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = quality_model.is_held_out(F.col("doc_id"))
    model = quality_model.train(docs, labels.where(~held_out))
    found = quality_model.score_quality(docs, model).where(held_out).join(labels, "doc_id").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    empty = quality_model.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))
    assert empty.score(quality_model.features_of([b"", b"a b"])).tolist() == [0.5, 0.5]


def test_url_reputation(spark):
    pages = [(1, "http://A.example.org/en/1x?q"), (2, "https://example.org/es/"), (3, "x://b.org/"), (4, None), (5, "no scheme"), (6, "http://s.com/fr/a#b"), (7, "http://com/de/"), (8, "http://bad.net/1"), (9, "http://bad.net"), (9, "http://bad.net")]
    outcomes = [(i, 0) for i in (8, 9)] + [(None, 1), (6, None)]
    for k in range(100, 160):
        pages.append((k, f"http://{'bad' if k % 2 else 'good'}.net/x"))
        outcomes.append((k, 0 if k % 2 else 1))
    found = url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "doc_id long, quality int"))
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.example.org", "/en/1x", "example.org/en/1", "block")]
    assert got[2] == [("example.org", "/es/", "example.org/es/", "block")]
    assert got[3] == [("b.org", "/", "org/", "allow")]
    assert got[4] == got[5] == [("", "", None, "allow")]
    assert got[6] == [("s.com", "/fr/a", "com/fr/", "allow")]
    assert got[7] == [("com", "/de/", "com/de/", "block")]
    assert got[9] == [("bad.net", "", None, "block")] * 2 and got[100][0][3] == "allow"


def reputation_twin(pages, outcomes):
    """Posterior upper bounds of all hosts, level by level in plain Python."""
    host = lambda u: re.match("[^/?#]*", u.split("://", 1)[1]).group().translate(fx.LOWER) if u and "://" in u else ""

    def levels(h):
        name = re.sub(r"\.?(:[0-9]*)?$", "", h.rpartition("@")[2])
        if re.match(r"[0-9]+(\.[0-9]+){3}$|\[", name):
            return name, "#address"
        parts = name.split(".")
        n = 2 if ".".join(parts[-2:]) in url_reputation.SUFFIXES else 1
        return ".".join(parts[-n - 1 :]), ".".join(parts[-n:])

    def strength(members):
        if len(members) < 2:
            return 2.0
        rates = [((k + 0.5) / (n + 1), n) for n, k in members]
        mean = sum(r for r, _ in rates) / len(rates)
        spread = sum((r - mean) ** 2 for r, _ in rates) / len(rates) - sum(r * (1 - r) / (n + 1) for r, n in rates) / len(rates)
        return min(200.0, max(2.0, mean * (1 - mean) / max(spread, 1e-6) - 1))

    best = {}
    for i, y in outcomes:
        if i is not None and y is not None:
            best[i] = max(best.get(i, 0), y)
    count = collections.defaultdict(lambda: [0, 0])
    for i, u in pages:
        if i in best:
            count[host(u)][0] += 1
            count[host(u)][1] += best[i]
    total = lambda rows: (sum(n for n, _ in rows), sum(k for _, k in rows))
    by_domain, by_suffix = collections.defaultdict(list), collections.defaultdict(list)
    for h, c in count.items():
        by_domain[levels(h)].append(c)
    for (d, s), rows in by_domain.items():
        by_suffix[s].append(total(rows))
    n, k = total([total(r) for r in by_suffix.values()])
    whole = (k + 1) / (n + 2), strength([total(r) for r in by_suffix.values()])
    suffix = {s: ((total(r)[1] + whole[0] * whole[1]) / (total(r)[0] + whole[1]), strength(r)) for s, r in by_suffix.items()}
    domain = {d: ((total(r)[1] + suffix[s][0] * suffix[s][1]) / (total(r)[0] + suffix[s][1]), strength(r)) for (d, s), r in by_domain.items()}
    out = {}
    for _, u in pages:
        d, s = levels(host(u))
        m, w = domain.get(d) or suffix.get(s) or whole
        n, k = count[host(u)] if host(u) in count else (0, 0)
        mean = (k + m * w) / (n + w)
        out[host(u)] = mean + 1.645 * (mean * (1 - mean) / (n + w + 1)) ** 0.5
    return out, host


def test_reputation_of_hosts_without_labels(spark):
    r = np.random.default_rng(8)
    hosts = [f"h{k}.bad.net" for k in range(6)] + [f"h{k}.good.net" for k in range(6)] + ["a.shop.co.uk", "b.shop.co.uk", "u@x.org:80", "10.0.0.1:8080", "10.0.0.2"]
    pages = [(k, f"http://{hosts[k % len(hosts)]}/p") for k in range(300)]
    outcomes = [(k, 0 if "bad" in u or "shop" in u else int(r.random() < 0.9)) for k, u in pages]
    pages += [(1000, "http://new.bad.net/"), (1001, "http://new.good.net"), (1002, "http://c.shop.co.uk:1"), (1003, "http://other.co.uk"), (1004, "http://x.unknown"), (1005, None), (1006, "http://10.0.0.1")]
    extra = [(*p, "h", 1, 2.0) for p in pages]
    frame = spark.createDataFrame(extra, "page_id long, url string, host string, n long, mean double")
    found = {x["page_id"]: x["verdict"] for x in url_reputation.judge_urls(frame, spark.createDataFrame(outcomes, "doc_id long, quality int"), rules=()).collect()}
    upper, host = reputation_twin(pages, outcomes)
    assert found == {i: "block" if upper[host(u)] < 0.5 else "allow" for i, u in pages}
    assert [found[k] for k in (1000, 1001, 1002, 1004, 1005)] == ["block", "allow", "block", "allow", "allow"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], fx.SCHEMA)
    model = language_id.train(none)
    bench = spark.createDataFrame([], "item_id long, text string")
    outcomes = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        suffix_dedup.remove_repeats(none), ngram_join.jaccard_components(none), decontamination.find_contamination(none, bench), line_dedup.drop_common_lines(none),
        packing.pack_documents(none, tokenizer_path()), quality_rules.apply_quality_rules(none), language_id.identify_languages(none, model), pii.find_personal_data(none),
        quality_model.score_quality(none, quality_model.train(none, outcomes)), url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), outcomes),
    ]
    assert [f.count() for f in frames] == [0] * 10


def test_connected_components(spark):
    r = np.random.default_rng(1)
    links = [(k, k + 1) for k in range(50)] + [(100, 90), (90, 95), (7, 7)] + [(int(a), int(b)) for a, b in r.integers(200, 400, (150, 2))]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = ngram_join.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    want = {x: root(x) for x in parent if any(a != b and x in (a, b) for a, b in links)}
    assert len(found) == len(want) and {x["node"]: x["component"] for x in found} == want
