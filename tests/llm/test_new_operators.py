"""Whitening, HTML extraction and the prefix trie against brute force and numpy."""

import hashlib
import html
import math
import random
import re
import struct
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletidy.llm import html_extract, prefix_trie, whitening
from tabletidy.llm import queries as Q

SF = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def brute_whitening(rows, k=4):
    """(n, deviation per id, trace, values, whitened per id with arbitrary signs) of clean rows."""
    xs = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, xs.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in xs.items()}
    white = {i: np.array([n * a - s for a, s in zip(v, sums)], float) / n @ axes / np.sqrt(values) for i, v in xs.items()}
    return n, deviation, (y * y).sum() / n, values, white


def check_whitening(got, clean, k=4):
    n, deviation, trace, values, white = brute_whitening(clean, k)
    assert len(got) == k * len(clean)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    signs = {}
    for r in got:
        j = r["component"] - 1
        want = white[r["vec_id"]][j]
        assert (r["n"], int(r["deviation"])) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-10)
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-7, abs=1e-8)
        if abs(want) > 1e-3:
            assert signs.setdefault(j, r["whitened"] * want > 0) == (r["whitened"] * want > 0)


def test_whitening_of_the_table(spark):
    clean = [(i, v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{SF}/embeddings.parquet')").fetchall()]
    check_whitening(Q.QUERIES["op11_whitening"](spark, SF).collect(), clean)


def test_whitening_edges(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-3, 3) * (1 + j) for j in range(5)]) for i in range(40)]
    good += [(100, good[0][1]), (101, [-0.0, 0.0, 300.0, -300.0, 1e-9]), (102, [0.0, -0.0, 300.0, -300.0, 1e-9])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf")] + [1.0] * 4), (205, [3e38] + [1.0] * 4), (206, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, VECTORS)
    check_whitening(whitening.whiten(df).collect(), good)
    clash = df.select("*", *[F.lit("z").alias(c) for c in ("key", "dim", "n", "component", "deviation", "v", "state", "bucket", "whitened")])
    check_whitening(whitening.whiten(clash, components=2).collect(), good, 2)
    nulls = spark.createDataFrame([*good, (None, good[1][1])], VECTORS)
    assert sum(r["vec_id"] is None for r in whitening.whiten(nulls).collect()) == 4
    for rows in ([], bad, [(1, [1.0, 2.0])] * 3):  # no rows, none that counts, no spread
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], VECTORS)).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)


def test_whitening_of_large_entries(spark):
    rng = random.Random(4)
    good = [(i, [rng.uniform(-1, 1) * 1e12 for _ in range(3)]) for i in range(50)]
    check_whitening(whitening.whiten(spark.createDataFrame(good, VECTORS), components=3).collect(), good, 3)
    x = np.array([[rng.randrange(-100, 100) for _ in range(8)] for _ in range(50)])
    for n in (50, 10**9, 10**13, 10**18):  # the sums of many more vectors: 64 bits hold them no longer
        sums = np.array([int(s) * (n // 50) for s in x.sum(axis=0)], object)
        assert whitening.deviations(x, n, sums) == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]


def test_packing():
    import pyarrow as pa

    x = np.array([[1, 2], [300, -5], [2**31 - 1, -(2**31)], [2**40, 1], [-128, 127], [-129, 0]])
    packed = whitening.pack(x)
    assert [len(p) for p in packed] == [3, 5, 9, 17, 3, 5]
    assert (whitening.unpack(pa.array(packed), 2) == x).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    q = np.linalg.qr(a)[0]
    low = a[:, :2]
    cases = [a @ a.T, np.diag(rng.integers(1, 4, n)).astype(float), q @ np.diag([5.0] * min(n, 3) + [1.0] * (n - min(n, 3))) @ q.T, low @ low.T, a @ a.T * 1e-200, np.zeros((n, n))]
    ranks = [min(4, n), min(4, n), min(4, n), min(2, n), min(4, n), 0]
    for v, rank in zip(cases, ranks):
        v = (v + v.T) / 2
        values, axes = whitening._leading(v, 4)
        assert len(values) == rank
        if rank:
            want = np.linalg.eigvalsh(v)[::-1][:rank]
            assert np.abs(values - want).max() <= 1e-13 * want[0]
            assert np.abs(v @ axes - axes * values).max() <= 1e-13 * want[0]
            assert np.abs(axes.T @ axes - np.eye(rank)).max() <= 1e-13


# --- HTML extraction -----------------------------------------------------------------------


def test_html_of_the_table(spark):
    """The pages' own layout: an article of headings and paragraphs, some without their end tags."""
    for r in Q.QUERIES["op12_html_extract"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("url", "u"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert (r["url"], r["n_chars"]) == (r["u"], len(r["text"]))


LINE = "Some words of a paragraph that goes on for a while, with commas, as a report does."


def page_layouts():
    """(markup, main text) of pages by several authors."""
    p2, p3 = " ".join([LINE] * 2), " ".join([LINE] * 3)
    yield (
        f'<html><head><title>T</title><style>p{{}}</style></head><body><div class="header"><a href=/>Home</a> Site</div><div id="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>'
        f'<div id="content"><h2>Head line</h2><p>{p3}<p>{p2}<p>Short one.<ul><li>point one<li>point two</ul><blockquote>{LINE}</blockquote></div>'
        f'<div class="sidebar"><p>Read <a href=x>more</a></p></div><div id="comments"><p>{p3}</p></div><div class="footer">Copyright</div><script>var x="</p><p>no</p>"</script></body></html>',
        ["Head line", p3, p2, "Short one.", "point one", "point two", LINE],
    )
    yield (  # no names at all: densities decide
        f"<body><table><tr><td><a href=1>aaa</a> <a href=2>bbb</a> <a href=3>ccc</a></td><td><p>{p3}</p><p>{p2}</p><p>{LINE}</p></td><td>Buy <a href=3>now</a>!</td></tr></table></body>",
        [p3, p2, LINE],
    )
    yield (
        f'<main><article class="post has-comments"><header class="entry-header"><h1>The title</h1></header><div class="entry-content"><p>{LINE}</p><aside>{p3}</aside><p>{p2}</p></div>'
        f'<section class="comments"><h2>Comments</h2><p>{p3} {p3}</p></section><form><p>{p3}</p></form><footer>By me</footer></article><aside><p>{p3}</p></aside></main>',
        ["The title", LINE, p2],
    )
    yield (
        f"<body><nav><a href=a>a</a></nav><article><h1>T &amp; U</h1><p>one<br>two &#8211;\n three&nbsp;&lt;b&gt;<p><b>{LINE}<br><p>{p2}</article><div class=ad>{p3}</div><div style='display: none'>{p3}</div><!-- {p3} -->",
        ["T & U", "one two – three <b>", LINE, p2],
    )
    yield f"<div role=banner>{p3}</div><div class='cookie-notice'>{p3}</div><p>{LINE}</p>", [LINE]


def test_html_layouts():
    for markup, blocks in page_layouts():
        assert html_extract.main_text(markup) == "\n\n".join(blocks)


def test_html_edges(spark):
    long = "word " * 400_000
    texts = [None, "", " \n ", "plain text", "<p>", "<script>x", "<!-- x", "a <b", f"<p>{long}</p>", "<p>same</p>", "<p>same</p>", "&#0000000000065;&#99999999999;&#x110000;&bogus;", "<" * 1000]
    want = ["", "", "", "plain text", "", "", "", "a", long.strip(), "same", "same", "A��&bogus;", "<" * 1000]
    pages = spark.createDataFrame([(i, f"u{i}" if i else None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    clash = pages.select("*", *[F.lit("z").alias(c) for c in ("text", "n_chars", "node", "block")])
    for df in (pages, clash):
        got = html_extract.extract_html(df).orderBy("page_id").collect()
        assert [r["text"] for r in got] == want
        assert [r["n_chars"] for r in got] == [len(t) for t in want]
        assert [r["url"] for r in got] == [None] + [f"u{i}" for i in range(1, len(texts))]
    assert html_extract.extract_html(pages.limit(0)).count() == 0
    assert html_extract.extract_html(pages.where("page_id = 9").select(F.lit(None).cast("long").alias("page_id"), "url", "html")).first()["page_id"] is None


@pytest.mark.parametrize("unit", ["<!--", "<a ", '<a href="', "</", "<?", "<![CDATA[", "<script>", "<b>", "<p><b>", "<li>", "<ul><li>", "<table><td>", "<a b=c ", "&amp", "<div>", "<p><button>", "</i>"])
def test_html_takes_linear_time(unit):
    began = time.process_time()
    html_extract.main_text("<i>" + unit * 40_000 + "text")
    assert time.process_time() - began < 5


def test_densities_by_definition():
    """Counts per subtree and the formula, stated once more on a small tree."""
    page = html_extract._Page()
    page.read("<body><div><p>aaaa</p><p>bb<a href=x>cc</a></p></div><p>dddddddd</p></body>")
    density, total = html_extract.densities(page)
    at = {t: i for i, t in enumerate(page.tags)}

    def formula(c, t, lc, lt, share):
        return c / t * math.log(c * t / (max(lc, 1) * max(lt, 1))) / math.log(math.log(c * max(lc, 1) / max(1, c - lc) + share * c + math.e))

    share = 2 / 16
    assert density[at["div"]] == pytest.approx(formula(8, 3, 2, 1, share))
    assert density[at["body"]] == pytest.approx(formula(16, 5, 2, 1, share))
    assert density[at["a"]] == 0
    assert total[at["body"]] == pytest.approx(density[at["div"]] + formula(8, 1, 0, 0, share))


# --- prefix trie ---------------------------------------------------------------------------

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute_trie(members):
    """Rows of the trie of {conv_id: [(role, text), ...]}, by its definition."""
    at, children = defaultdict(list), defaultdict(set)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
    for node in at:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(at, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(at[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    ends = {node: ",".join(str(c) for c in sorted(cs) if len(members[c]) == len(node)) for node, cs in at.items()}
    return sorted(
        ((min(cs), len(n), min(at[n[:-1]]) if n else None, len(cs), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, cs in at.items()),
        key=repr,
    )


def brute_rebuilt(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def trie_rows(df):
    return sorted((tuple(r[c] for c in prefix_trie.OUT) for r in df.collect()), key=repr)


def test_trie_of_the_table(spark):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM read_parquet('{SF}/conversations.parquet')").fetchall()
    assert trie_rows(Q.QUERIES["op13_prefix_trie"](spark, SF)) == brute_trie(brute_rebuilt(turns))


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_trie_edges(spark, most):
    """Copies, a hot first turn, nulls, ties, repeated rows, negative ids, absent first conversations, one long one."""
    r = random.Random(most)
    say = lambda: r.choice(["yes", "no", "ja, gewiß", "", None, "x" * 3000])
    turns = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), say()) for c in r.sample(range(-40, 200), 90) for t in range(r.randrange(1, 7))]
    turns += [(1000 + 5 * i, t, "user", f"copy {t}") for i in range(60) for t in range(3)]
    turns += [(2000 + 5 * i, t, "user", "hot" if t < 2 else f"{i}") for i in range(60) for t in range(3)]
    turns += [(3004, 0, "user", "only"), (3500, 1, "user", "b"), (3500, 1, "user", "b"), (3500, 1, "user", "a"), (None, 1, "user", "lost")]
    turns += [(4000, t, "user", f"{t % 7}") for t in range(400)]
    df = spark.createDataFrame(turns, TURNS).repartition(7)
    want = brute_trie(brute_rebuilt(turns))
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(df), most=most)) == want
    if most == 7:
        clash = df.select("*", *[F.lit("z").alias(c) for c in ("path", "key", "kind", "_group", "_base", "_head", "t", "unit", "depth", "parent_key", "ends")])
        assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(clash), most=most)) == want
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(df.limit(0)), most=most).count() == 0


def test_trie_of_own_turns(spark):
    """Without rebuilding, and with a conversation that has no turns."""
    turns = [(c, t, "user", f"{(c * t) % 3}") for c in range(30) for t in range(c % 5 + 1)]
    members = defaultdict(list)
    for c, _, role, text in turns:
        members[c].append((role, text))
    df = prefix_trie.paths(spark.createDataFrame(turns, TURNS)).select("conv_id", "path")
    assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(members)
    none = spark.sql("SELECT 77L AS conv_id, CAST('' AS binary) AS path")
    assert trie_rows(prefix_trie.prefix_trie(df.unionByName(none))) == brute_trie({**members, 77: []})


def test_double_array():
    """Every path walks to a node of its own prefix; slots are few."""
    for seed in range(60):
        r = random.Random(seed)
        kinds, n = r.choice([1, 2, 5, 500]), r.randrange(1, 200)
        found = sorted(b"".join(struct.pack(">16sI", hashlib.md5(b"%d" % r.randrange(kinds)).digest(), 1) for _ in range(r.randrange(0, 9))) for _ in range(n))
        lengths = np.array([len(p) // 20 for p in found])
        starts = np.cumsum(lengths) - lengths
        units = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 20)[:, :16].copy().view("S16").ravel()
        rows = np.repeat(np.arange(n), lengths)
        codes = prefix_trie.dense(units, rows, np.arange(len(units)) - starts[rows])
        assert set(codes.tolist()) == set(range(1, len(set(units.tolist())) + 1))
        trie = prefix_trie.DoubleArray(codes, starts, lengths)
        nodes = {}
        for p, a, k in zip(found, starts, lengths):
            state = np.zeros(1, np.int64)
            for d in range(k):
                state = trie.step(state, codes[a + d : a + d + 1])
                assert nodes.setdefault(p[: 20 * (d + 1)], int(state[0])) == state[0] > 0
        assert len(set(nodes.values())) == len(nodes) == (trie.check >= 0).sum()
        assert trie.step(np.zeros(1, np.int64), np.array([trie.n_codes + 9]))[0] == -1


# --- line dedup and the Jaccard join -------------------------------------------------------


def test_line_dedup_is_linear_in_a_text(spark):
    """A text of many lines that loses one (or half of them) takes time in proportion."""
    from tabletidy.llm.line_dedup import line_dedup

    common = [f"a line that many documents hold, number {i:06d}, of length" for i in range(16_000)]

    def took(n, lost):
        lines = [common[i] if i < lost else f"{i}" for i in range(n)]
        docs = [(0, "\n".join(lines))] + [(k, "\n".join(common[:lost])) for k in range(1, 6)]
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        began = time.perf_counter()
        got = {r["doc_id"]: r for r in line_dedup(df).collect()}
        assert got[0]["_n_dropped"] == lost and got[0]["_kept"] == "\n".join(lines[lost:])
        assert got[5]["_n_dropped"] == 0
        return time.perf_counter() - began

    took(2_000, 1)
    small = min(took(2_000, 1) for _ in range(2))
    assert took(32_000, 1) < 3 * small + 1
    assert took(32_000, 16_000) < 4 * small + 3


def test_partners_against_intersections():
    """Counts from bounds and intersections, against the definition."""
    from tabletidy.llm import jaccard_join as J

    for seed in range(150):
        r = np.random.default_rng(seed)
        base = r.choice(10**6, r.integers(5, 60), replace=False)
        sets = []
        for _ in range(r.integers(1, 30)):
            s = set(r.choice(base, r.integers(max(1, len(base) * 3 // 4), len(base) + 1), replace=False).tolist()) | set(r.integers(0, 10**6, r.integers(0, 5)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        copies, k, same = r.integers(1, 4, len(sets)), int(r.integers(1, len(sets) + 1)), bool(seed % 2)
        if same:
            k = len(sets)
        if not same and k == len(sets):
            continue
        want = np.zeros(len(sets), int)
        for i in range(len(sets)):
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and (same or (i < k) != (j < k)) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want[i] += copies[j]
        assert (J.partners(sets, copies, k, same) == want).all()


def test_folded_bitmaps_lose_no_link():
    from tabletidy.llm import jaccard_join as J

    r = np.random.default_rng(0)
    base = r.integers(0, 2**62, 5000).astype(np.uint64)
    sets = [base[: r.integers(1, size)] for size in r.choice([3, 40, 100, 200, 400, 5000], 200)]
    sets += [np.unique(np.r_[s[: max(1, len(s) * 9 // 10)], r.integers(0, 2**62, len(s) // 20).astype(np.uint64)]) for s in sets]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([len(s) for s in sets]), pa.array([J.folded(J.parity(s)) for s in sets], pa.binary())], ["n", "sign"])
    x = J._numbers(batch)
    a, b = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a[::37], b[::37])])
    n = x["n"]
    linked = 100 * both >= 80 * (n[a[::37]] + n[b[::37]] - both)
    ok = J.may_match(x, a[::37], b[::37])
    assert ok[linked].all() and linked.sum() > 50 and (~ok).sum() > 500


@pytest.mark.parametrize("block", [7, 512])
def test_link_counts(spark, monkeypatch, block):
    """n_links against all pairs, with classes in one and in many blocks."""
    from test_operators import frame, near_copies

    from tabletidy.llm import jaccard_join as J

    monkeypatch.setattr(J, "CLASS_SETS", block)
    draw = random.Random(3)
    texts = [*near_copies(draw, 60), *near_copies(draw, 40, 200, 9), None, "", "one", "one", "two words"]
    texts += texts[:25]
    sets = []
    for t in texts:
        words = (t or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    want = [sum(i != j and bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in J.jaccard_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_hot_lists_meet_in_bounded_groups(spark, monkeypatch):
    """Each pair of different classes of a hot list meets in exactly one group of two blocks at most."""
    from tabletidy.llm import jaccard_join as J

    monkeypatch.setattr(J, "HOT", 20)
    rows = [(1, 10, i, 5, 0, i) for i in range(200)]  # no two linked
    rows += [(2, 15, i, 5, 0, 7 if i < 250 else i) for i in range(300)]  # one large class
    rows += [(3, 2, i, 5, 0, i % 2) for i in range(30)] + [(4, 1, i, 5, 0, i) for i in range(15)]
    frame = spark.createDataFrame(rows, "token long, salts int, sid long, n int, pos int, label long")
    groups = {}
    for r in J.in_groups(frame).collect():
        groups.setdefault((r["token"], r["salt"]), []).append((r["sid"], r["label"], r["side"]))
    assert max(map(len, groups.values())) <= 4 * J.HOT  # two blocks, dealt by a hash
    for token in (1, 2, 3, 4):
        met = []
        for (own, _), held in groups.items():
            if own == token:
                met += [tuple(sorted((a[0], b[0]))) for i, a in enumerate(held) for b in held[:i] if a[1] != b[1] and (a[2] == 0 or a[2] != b[2])]
        members = [(r[2], r[5]) for r in rows if r[0] == token]
        want = {(a[0], b[0]) for a in members for b in members if a[0] < b[0] and a[1] != b[1]}
        assert len(met) == len(set(met)) and set(met) == want


def test_jaccard_with_saturated_counters(spark, monkeypatch):
    """Counters that call every list hot change no result, and salts come from counted lengths."""
    from test_operators import brute_classes, frame, near_copies

    from tabletidy.llm import jaccard_join as J

    monkeypatch.setattr(J, "SEGMENT", 1 << 11)
    monkeypatch.setattr(J, "COUNTERS", 1 << 11)
    monkeypatch.setattr(J, "HOT", 2)
    draw = random.Random(5)
    texts = near_copies(draw, 60)
    texts += [" ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(400)) for _ in range(60)]
    docs = frame(spark, texts)
    picked = J._picked(docs, "doc_id", "text")
    first = J.sets_and_counts(picked)
    posts = J.postings(picked, J.ranks(first.where("segment is not null"))).cache()
    assert posts.where("salts > 1").count() > posts.count() / 2  # what the sketch says
    lists = J.counted_lists(posts)
    lengths = {r["token"]: (r["k"], r["salts"]) for r in lists.groupBy("token", "salts").count().withColumnRenamed("count", "k").collect()}
    assert all(k > 1 and salts == -(-k // J.HOT) if salts > 1 else k > 1 for k, salts in lengths.values())
    distinct = posts.select("token", "sid").distinct().groupBy("token").count().where("count > 1")
    assert lists.count() == distinct.groupBy().sum("count").first()[0]  # every list of several, each entry once
    posts.unpersist()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(docs).collect()}
    assert got == brute_classes(dict(enumerate(texts)))
