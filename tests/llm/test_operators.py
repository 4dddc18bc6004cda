"""Each numbered operator against a brute-force version, and on awkward rows."""

import base64
import hashlib
import itertools
import random
import re
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, common, graph, mixing, quality, secrets, sharding, simhash, suffix, topk, urls
from sparkloom.llm.common import join_counted, shared_folder
from sparkloom.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def test_frequent_keys_join_like_others(spark):
    keys = [0] * 500 + [1] * 100 + list(range(2, 60)) + [99]
    rows_ = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    n = Counter(keys)
    per = spark.createDataFrame([(k, n[k], f"of {k}") for k in n if k != 99], "k long, n long, name string")
    for total in (len(keys), len(keys) * 150):  # all keys are frequent; two are
        got = sorted((r["k"], r["i"], r["name"]) for r in join_counted(rows_, per, "k", "n", total).collect())
        assert got == sorted((k, i, f"of {k}") for i, k in enumerate(keys) if k != 99)
    assert join_counted(rows_.limit(0), per.limit(0), "k", "n", 0).count() == 0


# 1 -----------------------------------------------------------------------------------------------


def test_mix_shares_and_repeats(spark, docs):
    out = mixing.plan_mix(docs).collect()
    total = sum(r["size"] for r in out)
    targets = {r["source"]: r["target"] for r in out}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    taken, size = Counter(), Counter()
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        size[r["source"]] += r["size"]
        assert 0 <= r["copies"] <= 3
    assert abs(sum(taken.values()) - total) < 0.1 * total
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(targets))}
    open_ = [targets[s] / weights[s] for s in targets if targets[s] < 3 * size[s] - 1e-6]
    assert max(open_) - min(open_) < 1e-6 * max(open_)
    assert sum(1 for _ in mixing.mix(docs).toLocalIterator()) == sum(r["copies"] for r in out)


def test_mix_stops_at_the_cap(spark):
    df = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1000, "b"), (1000, "c"), (7, None)])], "doc_id long, text string, source string")
    out = {r["source"]: r["target"] for r in mixing.plan_mix(df, weights=(100, 1, 1)).collect()}
    assert out["a"] == 30 and out[None] == 21 and out["b"] == out["c"] == (2017 - 51) / 2


def test_mix_edges(spark, edge_docs):
    out = mixing.mix_report(edge_docs).collect()
    assert len(out) == edge_docs.count() and all(r["size"] == 0 for r in out if r["doc_id"] in (2, 3, 6))
    assert mixing.mix(edge_docs.limit(0)).count() == 0 == mixing.mix_report(edge_docs.limit(0)).count()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_report(edge_docs).collect()))


# 2 -----------------------------------------------------------------------------------------------


def test_turns_read_back_as_written():
    random.seed(1)
    parts = [*chat.CONTROL, "\\", " ", "a", "\n", "<", "[", "é"]
    turns = [(random.choice(["user", "assistant", "system", "tool", "", "<s>", "\\"]), "".join(random.choices(parts, k=random.randint(0, 7)))) for _ in range(4000)]
    assert [t[:2] for t in chat.parse("".join(itertools.starmap(chat.render_turn, turns)))] == turns
    with pytest.raises(ValueError):
        chat.parse("[INST] open")
    with pytest.raises(ValueError):
        chat.parse("x" + chat.render_turn("user", "a"))


def test_chat_edges(spark):
    data = [(1, 0, "user", "[INST]\\</s>"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", "é" * 100_000), (2, 4, "tool", "x")]
    chats = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("piece", F.lit(1))
    pieces = chat.format_chats(chats)
    got = {r["conv_id"]: r for r in chat.read_back(pieces, arranged=True).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[2]["loss_chars"] == 100_000 and got[2]["loss_sha256"] == hashlib.sha256(("é" * 100_000).encode()).hexdigest()
    assert sorted(map(str, got.values())) == sorted(map(str, chat.read_back(pieces).collect()))
    for r in chat.assemble(pieces).collect():
        turns = chat.parse(r["formatted"])
        assert len(turns) == got[r["conv_id"]]["n_turns"] and len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"]
        assert [(s["start"], s["end"]) for s in r["loss_spans"]] == [(a, b) for role, _, a, b in turns if role == "assistant"]
    assert chat.read_back(chat.format_chats(chats.limit(0)), arranged=True).count() == 0


# 3 -----------------------------------------------------------------------------------------------


def test_urls_by_rule(spark):
    seen = {r["page_id"]: r for r in QUERIES["op3_urls"](spark, SF).collect()}
    for page, url in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = m[1].translate({c: c + 32 for c in range(65, 91)}) if m else ""
        path = m[2] if m else ""
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = seen[page]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fit)[1] if fit else None)
        assert r["verdict"] == (max(fit)[2] if fit else "block" if r["score"] > 0 else "allow")
    # The method by itself agrees with most of the rules' own verdicts.
    ruled = [r for r in seen.values() if r["rule"]]
    assert sum((r["score"] > 0) == (r["verdict"] == "block") for r in ruled) > 0.9 * len(ruled)


def test_naive_bayes_on_held_out_urls(spark):
    """Of URLs that no rule decides, weights learnt on some tell the others' kind by words inside their host names and paths."""
    random.seed(8)
    kinds = {"block": ["casino", "poker", "betting", "jackpot", "slots"], "allow": ["garden", "museum", "library", "science", "history"]}
    common_words = ["the", "best", "my", "online", "city", "world"]
    rows_, label = [], {}
    for i in range(600):
        kind = random.choice(["block", "allow"])
        name = "".join(random.sample(common_words, 1) + random.sample(kinds[kind], 2))
        tail = random.choice(kinds[kind] + common_words * 2)
        ruled = i % 2
        host = f"{name}.{'ruled' + kind[0] if ruled else 'free'}.net"
        rows_.append((i, f"http://{host}/{tail}/{i}", " ".join(common_words + kinds["block"] + kinds["allow"]) * 20))
        label[i] = kind
    rules = [("ruledb.net", "/", "block"), ("ruleda.net", "/", "allow")]
    out = urls.judge_urls(spark.createDataFrame(rows_, "page_id long, url string, html string"), rules).collect()
    free = [r for r in out if r["rule"] is None]
    right = sum(r["verdict"] == label[r["page_id"]] for r in free)
    assert len(free) == 300 and right >= 0.95 * len(free), right


def test_viterbi_splits_names():
    counts = {"cheap": 50, "pills": 40, "che": 1, "now": 90, "a": 5}
    assert urls.viterbi("cheappillsnow", counts, 200) == ["cheap", "pills", "now"]

    def best(token):  # every split
        cost = lambda w: __import__("math").log(counts[w] / 200) if w in counts else -__import__("math").log(201) - len(w) * __import__("math").log(10)
        return max(sum(map(cost, filter(None, re.split("/", "".join(c + s for c, s in zip(token, (*cuts, "")))))))  for cuts in itertools.product(["", "/"], repeat=len(token) - 1))

    for token in ("cheapnow", "anowpills", "xnow", "cheche"):
        cost = sum(__import__("math").log(counts[w] / 200) if w in counts else -__import__("math").log(201) - len(w) * __import__("math").log(10) for w in urls.viterbi(token, counts, 200))
        assert abs(cost - best(token)) < 1e-9


def test_url_edges(spark):
    data = [(1, None, None), (2, "", ""), (3, "no host", None), (4, "HTTP://Sub.Example.ORG/es/x?q", "<p>sub example</p>"), (5, "://", None), (5, "://", None), (6, "http://ÀB.com", None), (7, "http://" + "a" * 3000 + "/", None), (8, "x://org", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(9))
    out = {r["page_id"]: r for r in urls.judge_urls(pages, RULES).collect()}
    assert out[4]["rule"] == "example.org/es/" and out[4]["verdict"] == "block" and out[4]["host"] == "sub.example.org"
    assert out[1]["host"] == out[2]["host"] == out[3]["host"] == out[5]["host"] == "" and out[1]["verdict"] == "allow"
    assert out[8]["rule"] is None and out[6]["host"] == "Àb.com"
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


# 4 -----------------------------------------------------------------------------------------------


def test_shards_are_balanced(spark, docs):
    out = sharding.assign_shards(docs).select("text", "size", "tokens", "shard", "slot").collect()
    for what in ("size", "tokens", None):
        sums = Counter()
        for r in out:
            sums[r["shard"]] += r[what] if what else 1
        assert len(sums) == 8 and max(sums.values()) < 1.05 * min(sums.values()), (what, sums)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    groups = defaultdict(set)
    for r in out:
        groups[r["text"]].add(r["shard"])
    n = Counter(r["text"] for r in out)
    assert all(len(g) == 1 or n[t] > 1 for t, g in groups.items())


def test_large_groups_are_parted(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.assign_shards(df).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    assert max(r["n"] for r in out) < 1.1 * min(r["n"] for r in out) and max(r["s"] for r in out) < 1.1 * min(r["s"] for r in out)


def test_shard_edges(spark, edge_docs):
    out = sharding.assign_shards(edge_docs).collect()
    assert len(out) == edge_docs.count() and {r["size"] for r in out if r["text"] is None} == {1}
    assert sorted(map(str, out)) == sorted(map(str, sharding.assign_shards(edge_docs).collect()))
    assert sharding.assign_shards(edge_docs.limit(0)).count() == 0


# 5 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(spark, texts, library):
    for k, r in rows(spark, "op5_bpe").items():
        ids = library[1].encode_ordinary(texts[k])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()


def test_bpe_on_odd_texts(library):
    random.seed(2)
    v = bpe.Vocabulary(library[0], public_tokenizers.PATTERN)
    for text in ("a" * 50_000, " " * 3000 + "x", "\n" * 999, "".join(map(chr, range(1, 0x800))), *("".join(random.choices(["th", "er", " ", "é", "漢", "\n", "1", "🙂", "'s", "\0", "aa", "ing"], k=30)) for _ in range(3000))):
        assert list(array("I", v.encode(text))) == library[1].encode_ordinary(text)


def test_bpe_edges(spark, edge_docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_texts(edge_docs, path, public_tokenizers.PATTERN)
    got = out.collect()
    assert len(got) == edge_docs.count() and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in got)
    again = bpe.decode_ids(out.drop("decoded"), path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in again) == sorted(bytes(r["decoded"]) for r in got)
    assert bpe.encode_texts(edge_docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


# 6 -----------------------------------------------------------------------------------------------


def plain_print(text, width=4):
    w = re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most):
    up = {k: k for k in prints}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {k: find(k) for k in prints}


def test_simhash_components(spark, texts):
    prints = {k: plain_print(t) for k, t in texts.items()}
    components = plain_components(prints, 4)
    for k, r in rows(spark, "op6_simhash").items():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[k]:016x}", components[k])


@pytest.mark.parametrize(("hot", "segments", "radii"), [(1024, (22, 21, 21), (1, 1, 0)), (8, (32, 32), (2, 1))])
def test_links_lose_nothing(spark, monkeypatch, hot, segments, radii):
    monkeypatch.setattr(common, "HOT", hot)
    random.seed(5)
    prints = []
    for _ in range(60):
        centre = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 30])):
            x = centre
            for b in random.sample(range(64), random.randint(0, 6)):
                x ^= 1 << b
            prints.append(x)
    prints = dict.fromkeys(prints)
    df = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in prints], "fingerprint binary")
    roots = {bytes(r[0]): bytes(r[1]) for r in graph.connect(simhash.near_links(df, 4, segments, radii)).collect()}
    want = plain_components({x: x for x in prints}, 4)
    assert all(roots.get(x.to_bytes(8, "big"), x.to_bytes(8, "big")) == want[x].to_bytes(8, "big") for x in prints)


def test_long_chains_connect(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(0, 10, 2)]
    random.seed(1)
    random.shuffle(edges)
    df = spark.createDataFrame([tuple(x.to_bytes(8, "big") for x in e) for e in edges], "a binary, b binary")
    roots = {int.from_bytes(r[0], "big"): int.from_bytes(r[1], "big") for r in graph.connect(df).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1003] == 1002 and 0 not in roots


def test_simhash_edges(spark, edge_docs):
    got = simhash.near_components(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[3]["component_id"] == by[6]["component_id"] == 2 and by[5]["component_id"] == 4
    assert simhash.near_components(edge_docs.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------------------


def test_top_k_edges(spark):
    data = [(i, [float((i * 7) % 5), float(i % 3)]) for i in range(0, 40)] + [(100, [1.0, 1.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (None, [9.0, 9.0]), (7, [50.0, 0.0]), (500, [1.0]), (600, []), (11, [2.0, 2.0, 9.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    rows_ = [(i, [int(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and x == x for x in v)]
    for k in (3, 100):
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k).orderBy("query_id", "rank").collect()]
        want = []
        for q, v in sorted(r for r in rows_ if r[0] % 100 == 0):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows_ if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_in_blocks_and_with_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    random.seed(3)
    data = [(i, [random.choice([1e9, -3e9, 5.0, 0.0]) for _ in range(3)]) for i in range(60)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 4).orderBy("query_id", "rank").collect()]
    whole = {i: [int(1024 * x) for x in v] for i, v in data}
    clip = lambda s: max(-topk.LIMIT, min(topk.LIMIT, s))
    want = []
    for q in range(0, 60, 10):
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], w))), i) for i, w in whole.items() if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == want


# 8 -----------------------------------------------------------------------------------------------


def test_quality_counts(spark, texts):
    got = rows(spark, "op8_quality")
    for k, text in texts.items():
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality.KEEP)


def test_quality_holds_on_other_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))
    out = quality.judge_quality(docs, labels.filter(fold > 0)).join(labels.filter(fold == 0).withColumnRenamed("quality", "label"), "doc_id").filter("n_words >= 20").collect()
    good, bad = [[r["kept"] for r in out if r["label"] == y] for y in (1, 0)]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_quality_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (4, None, 0), (7, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(edge_docs, labels).count() == edge_docs.count()
    out = quality.judge_quality(edge_docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in out) and any(r["kept"] for r in out)
    assert quality.judge_quality(edge_docs.limit(0), labels).count() == 0
    assert quality.repeated_words(__import__("numpy").zeros(9, dtype=int)) == 9


# 9 -----------------------------------------------------------------------------------------------

PLAIN = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def test_secrets_by_plain_patterns(spark, texts):
    for k, r in rows(spark, "op9_secrets").items():
        spans = []
        for n, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
            own = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, texts[k]) if len(m[group]) >= least]
            assert r[f"n_{kind}"] == len(own)
            spans += own
        base = [s[2] for s in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN] == base


def test_ledger_scans_only_what_is_new(spark, edge_docs):
    path = shared_folder(spark, "test-ledger")
    secrets.extend_ledger(edge_docs.limit(8), path)
    before = secrets.read_ledger(spark, path).count()
    assert before == edge_docs.limit(8).select(secrets.blob_of(F.col("text"))).distinct().count() * len(secrets.RULES)
    secrets.extend_ledger(edge_docs.limit(8), path)
    assert secrets.read_ledger(spark, path).count() == before
    out = {r["doc_id"]: r for r in secrets.scan_secrets(edge_docs, path).collect()}
    blobs = edge_docs.select(secrets.blob_of(F.col("text"))).distinct().count()
    assert secrets.read_ledger(spark, path).count() == blobs * len(secrets.RULES)
    assert [s["kind"] for s in out[7]["secrets"]] == ["assign", "access", "hex"] and out[2]["secrets"] == []
    newer = (secrets.Rule("assign", 2, lambda text: []), *secrets.RULES[1:])
    out = {r["doc_id"]: r for r in secrets.scan_secrets(edge_docs, path, newer).collect()}
    assert [s["kind"] for s in out[7]["secrets"]] == ["access", "hex"]
    assert secrets.read_ledger(spark, path).count() == blobs * (len(secrets.RULES) + 1)
    assert secrets.scan_secrets(edge_docs.limit(0), path).count() == 0


def test_redaction(spark, edge_docs):
    found = secrets.scan_secrets(edge_docs, shared_folder(spark, "test-ledger"))
    out = {r[0]: r[1] for r in found.select("doc_id", secrets.redact("text", "secrets")).collect()}
    assert out[7] == '[SECRET]" [SECRET] [SECRET]' and out[2] is None and out[3] == "" and out[8] == "ünïcode ☃ 🙂 [SECRET] a\u00a0b"


# 10 ----------------------------------------------------------------------------------------------


def plain_removal(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def awkward_texts():
    random.seed(11)
    base = "".join(random.choice("abcé ") for _ in range(2500))
    texts = [None, "", "short", "short", "x" * 399, "x" * 399, "z" * 1700, "ab" * 600, base, base]
    for i in range(60):
        a = random.randint(0, 2000)
        own = "".join(random.choice("abcé ") for _ in range(random.randint(0, 300)))
        texts.append(own + base[a : a + random.randint(200, 700)] + own[::-1] + f"{i}")
    return texts


@pytest.mark.parametrize(("split", "hot"), [(4096, 1024), (3, 1024), (3, 4)])
def test_repeats_are_removed(spark, monkeypatch, split, hot):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(common, "HOT", hot)
    texts = awkward_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("times", F.lit(1))
    got = suffix.drop_repeats(df).orderBy("doc_id").collect()
    want = plain_removal([(t or "").encode() for t in texts], 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == want


def test_repeats_in_documents(spark, texts):
    got = rows(spark, "op10_suffix")
    keys = sorted(texts)
    for k, (n, gone, spans, kept) in zip(keys, plain_removal([texts[k].encode() for k in keys], 400)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_repeat_edges(spark, edge_docs):
    out = suffix.drop_repeats(edge_docs)
    assert out.count() == edge_docs.count() and all(r["n_removed"] == r["n_bytes"] > 0 for r in out.collect() if r["doc_id"] in (4, 5))
    assert suffix.drop_repeats(edge_docs.limit(0)).count() == 0
