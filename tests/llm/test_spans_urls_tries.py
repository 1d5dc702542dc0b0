"""Token spans, URL rules and conversation tries against brute force, on tables with nulls, empty and long texts, ties, repeated rows, clashing columns and hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from nightloom.llm import alignment, prefixtrie, urlfilter

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_sql(sql, **frames):
    db = duckdb.connect()
    for name, frame in frames.items():
        db.register(name, frame.toPandas().convert_dtypes(dtype_backend="pyarrow"))
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    return columns, sorted(map(str, found.fetchall()))


def rows(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


# --- token spans


def _text_rows():
    rng = random.Random(4)
    pieces = ["the", "naïve", "漢字", "😀🧬", "x" * 40, "don't", "a\nb", "1234567", "<|endoftext|>", "</s>", "é́", "--", "=" * 70, "ⅷ", "\u00a0z", "q\tr", "ﬁn"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [None, "", " ", "  two", "two  ", "a  b   c", "\n\nx", "has ▁ mark", "▁", "\x00\x1c y", "one", "one", " lead", "漢" * 300, "word " * 5000, "y" * 20000]
    return [(k if k % 9 else None, t, 7, "x", 1) for k, t in enumerate(texts)]


def _aligned_plainly(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = alignment.byte_of_character()
    of_a = {i: bytes(table[c] for c in t) if i != 50256 else t.encode() for t, i in a.get_vocab().items()}
    docs = []
    for text in texts:
        raw = f" {text}".encode() if text else b""
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        x_bytes = [of_a[k] for k in x]
        y_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not raw or b"".join(x_bytes) != raw or b"".join(y_bytes) != raw:
            docs.append(([], [], []))
            continue
        ends = []
        for parts in (x_bytes, y_bytes):
            total, at = 0, []
            for p in parts:
                total += len(p)
                at.append(total)
            ends.append(at)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = [], []
            while i < len(x) and ends[0][i] <= c:
                p.append(x[i])
                i += 1
            while j < len(y) and ends[1][j] <= c:
                q.append(y[j])
                j += 1
            groups.append((p, q))
        docs.append((x, y, groups))
    counts = defaultdict(int)
    for _, _, groups in docs:
        for pair in {(p, q) for ps, qs in groups for p in ps for q in qs}:
            counts[pair] += 1
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for x, y, groups in docs:
        links = [(p, q) for ps, qs in groups for p in ps for q in qs]
        text = ";".join(f"{','.join(map(str, ps))}|{','.join(map(str, qs))}" for ps, qs in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


@pytest.mark.parametrize("broadcast_pairs", [2_000_000, 5])
def test_spans_equal_plain_alignment(spark, broadcast_pairs):
    data = _text_rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, a int, pair string, n int").repartition(3)
    found = alignment.align_documents(docs, A, B, broadcast_pairs).collect()
    assert found[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(row[0], *rest) for row, rest in zip(data, _aligned_plainly([r[1] for r in data]), strict=True)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 40 and any(w[1] == 0 and r[1] for w, r in zip(want, data, strict=True))
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0


def test_memory_of_chunks_starts_anew():
    texts = [r[1] for r in _text_rows()]
    small, large = alignment.Aligner(A, B, remembered=5), alignment.Aligner(A, B)
    for t in texts:
        (c, d, e, f, _), (p, q, r, s, _) = small.texts([t]), large.texts([t])
        assert (c == p).all() and d == q and (e == r).all() and (f == s).all()


def test_spans_alone_are_refined():
    """A character of three tokens on either side: the coarse cuts leave it whole, decoded bytes cut it."""
    whole, a, b, ga, gb, chunk = alignment.Aligner(A, B).align(["c", "漢", "▁", "x😀y"])
    assert whole.tolist() == [True, True, False, True] and set(ga.tolist()) == set(gb.tolist()) == set(range(len(chunk)))
    assert chunk.tolist() == sorted(chunk.tolist()) and set(chunk.tolist()) == {0, 1, 3} and (chunk == 1).sum() > 1


# --- URL rules


def _urls():
    rng = random.Random(2)
    hosts = ["example.org", "www.EXAMPLE.org", "badexample.org", "a.b.example.org", "x.com", "com", "org", "x.com.net", "example.org.", "example.org:80", ""]
    paths = ["/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/fr", "/de/x", "", "/", "/DE/", "/es/?q=/de/", "/é/"]
    ends = ["", "?a=://b/c", "#x/de/", "?"]
    urls = [f"{s}://{h}{p}{e}" for s in ("http", "HTTPS", "a\nb") for h in hosts for p in paths for e in ends]
    return urls + [None, "", "no scheme/de/", "://", "x://", "http:/x.com/de/", "http://x.com#/de/"] + [rng.choice(urls) for _ in range(50)]


def test_urls_equal_sql(spark):
    pages = spark.createDataFrame([(k if k % 11 else None, u, "h", "r", "v", "k") for k, u in enumerate(_urls())], "page_id long, url string, host string, rule string, verdict string, key string")
    columns, want = by_sql(urlfilter.URL_SQL, pages=pages.select("page_id", "url"))
    out = urlfilter.judge_pages(pages)
    assert sorted(out.columns) == sorted(columns) and rows(out, columns) == want
    assert out.filter("verdict = 'block'").count() > 50 and urlfilter.judge_pages(pages.limit(0)).count() == 0


def test_many_rules_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.{d}" for i in range(60) for d in ("com", "org", "x.net")]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}/{rng.choice('abc')}/{rng.randrange(50)}" for _ in range(800)] + ["http://hot.com/a/1"] * 400
    rules = {(rng.choice([*hosts, "com", "net", "hot.com"]), "/" + rng.choice(["", "a/", "b/", "a/1"])): rng.choice(["allow", "block"]) for _ in range(200)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], urlfilter.RULE_SCHEMA)
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, table, "unknown").collect()}
    for k, u in enumerate(urls):
        h, p = u.split("://", 1)[1].split("/", 1)
        best = max(((len(a + b), len(a), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and f"/{p}".startswith(b)), default=None)
        assert found[k] == ((best[2], best[3]) if best else (None, "unknown"))
    assert {r.verdict for r in urlfilter.judge(pages, table.limit(0), "block").collect()} == {"block"}


@pytest.mark.parametrize("first,max_bits,parts", [(16, 2**27, 1), (1, 2**27, 1), (16, 1024, 8)])
def test_cascade_is_exact_over_its_universe(spark, first, max_bits, parts):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    listed = universe.filter("hash(key) % 5 = 0")
    made = urlfilter.build_cascade(listed, universe, first, max_bits=max_bits)
    assert len(made.parts) == parts and max(map(len, made.parts)) >= 2
    found = universe.select("key", made.listed(F.col("key")).alias("on"), F.coalesce(F.expr("hash(key) % 5 = 0"), F.lit(False)).alias("want"))
    assert found.filter("on <> want").count() == 0 and found.filter("on").count() > 300


# --- tries


def _conversations(spark, seed=0):
    rng = random.Random(seed)
    data = []
    for c in [*range(0, 90), *range(200, 215), -7, -40, 10**15 + 7]:
        if c % 17 == 3 and c % 20:
            continue
        n = rng.choice([1, 2, 3, 4, 6, 9])
        for t in range(n):
            data.append((c, rng.choice([t, t, None]) if c % 13 == 5 else t, rng.choice(["user", "assistant", None, ""]) if c % 7 == 1 else ["user", "assistant"][t % 2], rng.choice(["hi there", "hi  there", "", None, "a b c", f"x {rng.randrange(3)}"])))
    data += [(400 + k, t, "user", "same" if t < 2 else f"own {k % 3}") for k in range(60) for t in range(4)]  # a hot beginning
    data += [(777, t, "user", f"long {t % 5}") for t in range(2500)] + [(778, t, "user", f"long {t % 5}") for t in range(2400)]
    data += [(5, 1, "user", "again")] * 3 + [(None, 0, "user", "nobody"), (800, None, None, None)]
    return spark.createDataFrame([(*r, 1, "z") for r in data], "conv_id long, turn long, role string, text string, depth int, n_convs string").repartition(7)


def _plain_trie(table):
    turns = defaultdict(list)
    for r in table.collect():
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            turns[r.conv_id].append((r.turn is not None, r.turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        path = turns.get(base, [])[:h] + turns[c][h:]
        node = ()
        members[node].append(c)
        for turn in path:
            node = (node, turn)
            members[node].append(c)
        ends[node].append(c)
    names = {n: (min(m), _depth) for n, m in members.items() for _depth in [0]}
    depth = {}
    for n in sorted(members, key=lambda n: _length(n)):
        depth[n] = depth[n[0]] + 1 if n else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in sorted(members, key=lambda n: -depth[n]):
        leaves[n] += not children[n]
        saved[n] += (len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[1][1])) if n else 0)
        if n:
            children[n[0]] += 1
            leaves[n[0]] += leaves[n]
            saved[n[0]] += saved[n]
    return sorted(str((names[n][0], depth[n], names[n[0]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())) for n, m in members.items())


def _length(node):
    n = 0
    while node:
        node, n = node[0], n + 1
    return n


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_sql(spark):
    table = _conversations(spark).filter("conv_id NOT IN (777, 778) OR conv_id IS NULL")
    columns, want = by_sql(prefixtrie.TRIE_SQL, conversations=table.select("conv_id", "turn", "role", "text"))
    for hot in (None, 3):
        out = prefixtrie.trie(table, hot)
        assert sorted(columns) == sorted(out.columns) == sorted(COLUMNS) and rows(out, columns) == want
    assert prefixtrie.trie(table.limit(0)).count() == 0


def test_long_conversations_run_over_tasks_and_blocks(spark, monkeypatch):
    """Prefixes of 2,500 turns, in ranges that cut through a conversation, against products turn by turn."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 64)
    table = _conversations(spark).filter("conv_id IN (777, 778, 760, 5)").unionByName(_conversations(spark).filter("conv_id >= 400 AND conv_id < 420"))
    placed = prefixtrie.placed_turns(prefixtrie.turns_of(table))
    assert placed.groupBy("conv_id").agg((F.max("pos") == F.count("pos")).alias("a"), (F.countDistinct("pos") == F.count("pos")).alias("b")).filter("NOT a OR NOT b").isEmpty()
    out = {(r.conv_id, r.depth): r for r in prefixtrie.trie(table).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (777, 778)}
    top = max(d for c, d in out if c == 777)
    assert top == 2500 - h[777]  # 760 is absent, so nothing is put ahead
    if h[777] == h[778]:
        assert out[777, 100].n_convs == 2 and out[777, 100].n_leaves == 1
    assert out[777, top].n_children == 0 and out[777, top - 1].n_children == 1 and out[777, top].parent_conv_id == 777
    total = sum((r.n_convs - 1) * 2 for (c, d), r in out.items() if c == 777 and d > 1000)
    assert out[777, 1001].saved_tokens == total


def test_deep_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 16)
    table = _conversations(spark, 3).filter("conv_id NOT IN (777, 778)").unionByName(_conversations(spark, 3).filter("conv_id IN (777, 778) AND turn < 150"))
    assert rows(prefixtrie.trie(table), COLUMNS) == _plain_trie(table)


def test_equal_fingerprints_are_noticed(spark, monkeypatch):
    """Maps that tell no turns apart are given up for others."""
    real, seeds = prefixtrie._turn_maps, []
    table = _conversations(spark).filter("conv_id < 40")
    want = rows(prefixtrie.trie(table), COLUMNS)
    grouped = prefixtrie._grouped
    monkeypatch.setattr(prefixtrie, "_grouped", lambda members: (seeds.append(1), grouped(members if len(seeds) > 1 else members.withColumns({f"f{k}": F.lit(0).cast("long") for k in range(4)})))[1])
    assert rows(prefixtrie.trie(table), COLUMNS) == want and len(seeds) == 2 and real is prefixtrie._turn_maps
