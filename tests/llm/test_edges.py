"""Odd tables: any dealing of rows, extra columns with clashing names, nulls, very long texts, empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemark.llm import chat, decontaminate, fingerprints, language, minhash, packing, quality, recompress, suffix_dedup, wrappers

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use inside.
CLASHING = ("_id", "_mark", "_kept", "_said", "_row", "_none", "block", "bucket", "row", "part", "data", "mark", "said", "k", "id", "n", "hub", "band", "order", "rank", "words", "kept", "score", "_by")


def rows_of(df, *columns):
    return collections.Counter(tuple(str(x) for x in r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").cache()
    return {x: read(x) for x in ("documents", "labels", "benchmark", "pages", "conversations")}


@pytest.fixture(scope="module")
def odd(spark):
    """documents with nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(120_000))
    said = " ".join(f"s{rng.randrange(300)}" for _ in range(200))
    texts = [None, "", " \n\n ", "one", said, said, said + " more", long, "x" * 300_000, said.replace("s1 ", "t1 "), "\n".join(["line"] * 3_000)]
    rows = [(i, t, ("en", None)[i % 2], None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, said, None, None, None), (None, None, None, None, None), (4, "another text under a used id", "en", "s", 28)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(5).cache()


def test_predictions_do_not_depend_on_how_rows_are_dealt(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang").orderBy("doc_id")
    model = language.learn(docs)
    field = quality.learn(docs, tables["labels"], 200)
    for work in (lambda df: language.identify(df, model), lambda df: quality.classify(df, field)):
        one = rows_of(work(docs.coalesce(1)))
        assert one == rows_of(work(docs.repartition(7))) == rows_of(work(docs.orderBy(F.desc("doc_id")).coalesce(1)))
    again = language.learn(docs.repartition(6))
    assert again.languages == model.languages and np.array_equal(again.chances, model.chances)
    other = quality.learn(docs.repartition(3), tables["labels"].repartition(5), 200)
    assert np.allclose(other.weights, field.weights) and np.allclose(other.curve, field.curve)


def test_main_texts_do_not_depend_on_how_pages_are_dealt(spark):
    part = "<div class=part><h2>Part {1} of {0}</h2><p>Some words of {0}.</p></div>"
    page = "<body><div class=top>The site</div><div id=content><h1>Story {0}</h1>" + part.replace("{1}", "a") + "{x}" + part.replace("{1}", "b") + "</div><div class=foot>All rights</div></body>"
    rows = [(i, f"http://h{i % 3}.example/{i}", page.replace("{x}", "<ul><li>extra {0}</li><li>more</li></ul>" if i % 4 == 0 else "").replace("{0}", str(i))) for i in range(36)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = rows_of(wrappers.extract(df.coalesce(1)))
    assert all("The site" not in str(r) and "All rights" not in str(r) and "Part b" in str(r) for r in one)
    for parts in (4, 9):
        assert rows_of(wrappers.extract(df.repartition(parts))) == one


def test_a_letter_does_not_reach_into_the_next_text():
    one, ends = language.trigrams(["ab"])
    both, bounds = language.trigrams(["ab", None, "xy", "1 2", "z"])
    assert one.tolist() == both[: bounds[1]].tolist() and bounds.tolist() == [0, 2, 2, 4, 4, 5] and ends.tolist() == [0, 2]
    assert language.trigrams(["  a1b "])[0].tolist() == language.trigrams(["a b"])[0].tolist()


def slow_mixture(model, grams):
    """The best set by trying all sets of the largest shares, in plain steps."""
    def em(p):
        share = [1 / len(p[0])] * len(p[0])
        for _ in range(language.ROUNDS):
            mean = [0.0] * len(share)
            for row in p:
                total = sum(s * x for s, x in zip(share, row, strict=True))
                for j, x in enumerate(row):
                    mean[j] += x / total / len(p)
            share = [s * m for s, m in zip(share, mean, strict=True)]
        return [s / sum(share) for s in share]

    p = [[float(x) for x in model.chances[g]] for g in grams]
    share = em(p)
    order = sorted(range(len(share)), key=lambda j: -share[j])
    best = (-math.inf, None, None)
    for k in range(1, len(order) + 1):
        some = [[row[j] for j in order[:k]] for row in p]
        own = em(some)
        value = sum(math.log(sum(s * x for s, x in zip(own, row, strict=True))) for row in some) - language.PENALTY * k * math.log(len(grams) + 1) / 2
        if value > best[0]:
            top = max(range(k), key=lambda j: own[j])
            best = (value, order[top], share[order[0]] if k == 1 else own[top])
    return best[1:]


def test_mixtures_against_plain_steps(tables):
    docs = tables["documents"]
    model = language.learn(docs)
    rows = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    mixed = [a[:150] + " " + b[:n] for a, b, n in zip(rows, rows[20:], (10, 40, 90, 150) * 15, strict=False)]
    for text in [x[:300] for x in rows] + mixed:
        grams, ends = language.trigrams([text])
        if not ends[-1]:
            continue
        (lang, share), (want, wanted) = model.mixture(grams), slow_mixture(model, grams)
        assert lang == want and share == pytest.approx(wanted, abs=1e-3)


def slow_quality(field, text):
    """A document's score by all forward and backward sums, line by line."""
    x, lengths = quality.features((text or "").encode())
    score = [[0.0, float(row @ field.weights)] for row in x]
    n, follow = len(score), field.follow
    forward, back = [score[0]], [[0.0, 0.0]]
    for t in range(1, n):
        forward.append([score[t][b] + np.logaddexp(forward[-1][0] + follow[0, b], forward[-1][1] + follow[1, b]) for b in (0, 1)])
    for t in range(n - 2, -1, -1):
        back.insert(0, [np.logaddexp(follow[a, 0] + score[t + 1][0] + back[0][0], follow[a, 1] + score[t + 1][1] + back[0][1]) for a in (0, 1)])
    total = np.logaddexp(*forward[-1])
    good = [math.exp(forward[t][1] + back[t][1] - total) for t in range(n)]
    mean = sum(g * m for g, m in zip(good, lengths, strict=True)) / sum(lengths)
    a, b = field.curve
    return 1 / (1 + math.exp(-(a * mean + b)))


def test_scores_against_plain_sums(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    fold = quality.bucket_of_id("doc_id", 5) == 0
    field = quality.learn(docs, labels.where(~fold))
    got = quality.held_out(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = slow_quality(field, texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.predicted == (want >= 0.3) or abs(want - 0.3) < 1e-6)


def test_odd_documents_in_every_operator(spark, odd, tables):
    n = odd.count()
    assert fingerprints.edited_documents(odd).count() == n
    assert decontaminate.decontaminate(odd, tables["benchmark"]).count() == n
    assert language.identify(odd, language.learn(odd)).count() == n and language.held_out(odd).count() == n
    assert minhash.near_duplicates(odd).count() == n
    assert quality.held_out(odd, tables["labels"]).count() == n
    got = packing.pack(odd, TOKENIZER)
    assert got.where("piece = 0").count() == n
    cut = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.suffix_dedup(odd).collect()}
    assert cut[8, 300_000].n_removed == 0 and cut[5, cut[4, max(b for d, b in cut if d == 4)].n_bytes].n_removed > 0
    words = recompress.remove_repeats(odd)
    assert words.count() == n and words.where("doc_id = 7").first().n_words == 120_000
    assert words.where("doc_id = 5").first().n_removed == 200


def test_values_of_odd_documents(spark, odd, tables):
    """What the operators say of nulls, empty, very long and repeated texts, by plain steps."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    known = [(str(r.item_id), r.text or "") for r in tables["benchmark"].collect()]
    long, said = (next(t for d, t in rows if d == k) for k in (7, 5))
    known += [("long", " ".join(long.split()[40_000:40_010])), ("said", said), ("line", "line " * 3), ("nothing", " - ")]
    items = spark.createDataFrame(known, "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    # benchmark windows
    windows = collections.defaultdict(set)
    for i, t in known:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = collections.Counter()
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    got |= found
                    hit |= set(range(k, k + n))
        want[d, len(w), len(hit), tuple(sorted(got))] += 1
    found = decontaminate.decontaminate(odd, items).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == want and any("long" in x[3] for x in want)

    # near copies
    shingles = []
    for d, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        shingles.append((d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {d: d for d, _ in rows if d is not None}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, x), (b, y) in itertools.combinations([s for s in shingles if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd).where("doc_id IS NOT NULL").collect())
    assert got == collections.Counter((d, len(x), top(d)) for d, x in shingles if d is not None)

    # quality and language
    fold = quality.bucket_of_id("doc_id", 5) == 0
    field = quality.learn(odd, tables["labels"].where(~fold))
    want = sorted(((d is not None, d or 0), round(slow_quality(field, t), 5)) for d, t in rows)
    assert [((r.doc_id is not None, r.doc_id or 0), round(r.score, 5)) for r in sorted(quality.held_out(odd, tables["labels"]).collect(), key=lambda r: ((r.doc_id is not None, r.doc_id or 0), round(r.score, 5)))] == want
    model = language.learn(tables["documents"])
    short = [(d, t) for d, t in rows if t is None or len(t) < 2_000]
    asked = spark.createDataFrame(short, "doc_id long, text string")
    want = collections.Counter()
    for d, t in short:
        grams, ends = language.trigrams([t])
        want[d, model.languages[slow_mixture(model, grams)[0]] if ends[-1] else "und"] += 1
    assert collections.Counter((r.doc_id, r.lang_pred) for r in language.identify(asked, model).collect()) == want

    # pieces
    coder = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for d, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        at, k, size = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want[d, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, k, size = at + size, k + 1, 1024
    placed = packing.pack(odd, TOKENIZER).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    taken = collections.defaultdict(list)
    for r in placed:
        taken[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(x)[:k]) == o for x in taken.values() for k, (o, _) in enumerate(sorted(x))) and all(sum(n for _, n in x) <= 1024 for x in taken.values())


def test_odd_documents_in_every_stage(spark, odd, tmp_path):
    docs, columns = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns and out.dtypes == odd.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = docs.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in left] in ([tuple(f"own {c}" for c in CLASHING)], [])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("piece = 0").count() == docs.count()
    alone = {r.doc_id for r in minhash.one_of_each(odd).where("doc_id IS NOT NULL").collect()}
    assert {0, 1, 2, 3, 4, 7, 8, 10} <= alone and 5 not in alone


def test_stages_on_an_empty_table(spark, odd, tables):
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
    assert decontaminate.clean(odd, tables["benchmark"].limit(0)).count() == odd.count()
    assert quality.good(odd, tables["labels"].limit(0)).count() == odd.count()  # 0.5 for all


def test_the_pipeline_on_an_empty_folder(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        tables[name].limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_conversations_and_pages_with_odd_columns(spark):
    talk = spark.createDataFrame([(1, 1, "user", "x" * 400_000), (1, 2, None, None), (None, None, None, None), (1, 1, "user", "x" * 400_000)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(talk.withColumns({c: F.lit(1) for c in ("part", "place", "conv", "costs", "cost", "rendered")}))
    assert out.count() == 4
    page = "<div>" + "<p>word</p>" * 6_000 + "</div>"
    pages = spark.createDataFrame([(1, "http://a/", page), (1, "http://a/", page), (2, None, None), (None, "http://a/", "<p>x")], "page_id long, url string, html string")
    texts = wrappers.extract(pages.withColumns({c: F.lit(1) for c in ("host", "part", "pattern", "marks", "text", "n_chars", "paths")}))
    assert texts.count() == 4 and texts.where("page_id = 1").first().n_chars == 6_000 * 4 + 5_999 * 2


def test_words_are_hashed_alike_wherever_they_stand():
    from pagemark.llm import common

    rng = random.Random(2)
    texts = [b"", b" \n", b"a b\ta", *(bytes(rng.choice(b"ab \n\x0b\x0c\r\t\xc3\xa9") for _ in range(rng.randrange(60))) for _ in range(300)), b"x" * common.WORD_CHUNK + b" a"]
    hashes, counts = common.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    by_word = collections.defaultdict(set)
    for w, h in zip(words, hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len({min(x) for x in by_word.values()}) == len(by_word)
    sums = common.Sums(hashes)
    at = np.arange(len(hashes) - 5)
    seen = collections.defaultdict(set)
    for i, h in zip(at.tolist(), sums.of(at, at + 5).tolist(), strict=True):
        seen[tuple(words[i : i + 5])].add(h)
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(seen)


def test_digests_of_removed_text(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    df = spark.createDataFrame([(1, text), (2, "so " + text), (3, text[:40])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(df)).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(0, 0), (len(text), 1), (0, 0)]
    assert got[2].kept_sha256 == hashlib.sha256(b"so ").hexdigest()


def cheapest(roles):
    """Least cost of a repair by shortest ways: states after each turn, with messages put in as steps of their own."""
    ways = {chat.START: 0.0}
    follows = {chat.START: (chat.SYSTEM, chat.USER), chat.SYSTEM: (chat.USER,), chat.USER: (chat.ASSISTANT,), chat.ASSISTANT: (chat.USER,)}

    def inserted(ways):
        out = dict(ways)
        for _ in range(4):
            for a, cost in list(out.items()):
                for b in follows[a]:
                    if b != chat.SYSTEM and cost + chat.INSERT < out.get(b, math.inf):
                        out[b] = cost + chat.INSERT
        return out

    for role in roles:
        known = chat.state_of(role)
        after: dict = {}
        for now, base in inserted(ways).items():
            for new in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                own = 0.0 if known == new else chat.RELABEL if known else chat.GUESS
                step = 0.0 if new in follows[now] else chat.MERGE if new == now and now in ways else None
                if step is not None:
                    total = base + own + step if new != now else ways[now] + own + step
                    after[new] = min(after.get(new, math.inf), total)
        ways = after
    return min(cost for state, cost in inserted(ways).items() if state in (chat.ASSISTANT, chat.START))


def test_long_repairs_cost_as_little_as_can_be():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 8, 30, 300):
        for _ in range(20):
            roles = [rng.choice(["user", "assistant", "system", "gpt", "tool", None]) for _ in range(n)]
            assert chat.repair(roles)[1] == pytest.approx(cheapest(roles))
