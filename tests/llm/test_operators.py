"""Each operator against SQL or a brute-force statement, on the driver tables and on edge cases."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import types as T

from tabletidy.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def driver_texts(sf=SF):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(Q.ORACLE_SQL[name]).fetchdf()
    assert sorted(want.columns) == names
    assert rows(got, *names) == sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({Q.ORACLE_SQL[name]})").fetchall()), key=repr)


EDGE = [None, "", " ", "A b", "a  b", "A\tb", "A b", "x" * 50, "line one is long enough to be counted, surely.\nother"] + ["Line one is long enough to be counted, surely. \n\nz"] * 6


def test_exact_dedup_edges(spark):
    from tabletidy.llm.exact_dedup import exact_dedup

    got = exact_dedup(frame(spark, EDGE, [None, *range(1, len(EDGE) - 1), 1]), max_bits=1 << 16).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert {len(v) for v in by.values()} == {v[0]["group_size"] for v in by.values()}
    assert all(sum(r["kept"] for r in v) == 1 for v in by.values())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert set(by) == {sha(norm(t)) for t in EDGE}
    assert exact_dedup(frame(spark, [])).collect() == []


def test_line_dedup_edges(spark):
    from tabletidy.llm.line_dedup import drop_lines, line_dedup

    docs = frame(spark, EDGE, [None, *range(1, len(EDGE) - 1), len(EDGE) - 2])  # the last id twice
    got = line_dedup(docs)
    assert got.count() == len(EDGE)
    last = len(EDGE) - 2
    kept = {r["_kept"] for r in got.where(f"doc_id = {last}").collect()}
    assert kept == {EDGE[-1]}  # the largest id keeps its lines in both of its rows
    assert {r["_kept"] for r in got.where("doc_id between 9 and 12").collect()} == {"\nz"}
    assert got.where("doc_id = 8").collect()[0]["_kept"] == "other"
    assert drop_lines(docs).columns == docs.columns
    assert drop_lines(docs).where("text is null").count() == 1
    assert drop_lines(frame(spark, [])).collect() == []


def test_license_brute_force(spark):
    from tabletidy.llm.license_scan import BASE, evaluate, license_scan

    texts = {**driver_texts(), 10**6: "MIT License, mit-license; Cc-By-Sa\n# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Foo WITH Bar */", 10**6 + 1: None, 10**6 + 2: "ünder the apache license", 10**6 + 3: "cc by cc by xmit license"}
    out = {r["doc_id"]: r for r in license_scan(frame(spark, list(texts.values()), list(texts))).collect()}
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[10**6]["labels"] == "cc-by,cc-by-sa,foo+bar,gpl-2.0-only,mit"
    assert evaluate("MIT OR") == ({"mit"}, 1.0) and evaluate("and x") == (set(), 0.0) and evaluate("a and b or MIT") == ({"a", "b", "mit"}, 1.0)
    assert license_scan(frame(spark, [])).collect() == []


def test_license_expressions():
    """Listed identifiers only, later versions, references, and exceptions behind single licences."""
    from tabletidy.llm.license_scan import evaluate

    assert evaluate("gpl-99.9")[1] == 0.5 and evaluate("mit-anything")[1] == 0.5 and evaluate("bsd")[1] == 0.5
    assert evaluate("Apache-2.0+") == ({"apache-2.0+"}, 1.0) and evaluate("GPL-2.0-only+")[1] == 0.5 and evaluate("cc-by-sa-4.0")[1] == 1.0
    assert evaluate("LicenseRef-own.1") == ({"licenseref-own.1"}, 0.75) and evaluate("DocumentRef-a:LicenseRef-b")[1] == 0.75
    assert evaluate("GPL-2.0-or-later WITH Classpath-exception-2.0") == ({"gpl-2.0-or-later+classpath-exception-2.0"}, 1.0)
    assert evaluate("GPL-2.0-only with my-exception")[1] == 0.5
    # a bracket or another exception can't stand on either side of "with"
    assert evaluate("(MIT or ISC) with LLVM-exception") == ({"mit", "isc"}, 1.0)
    assert evaluate("MIT with (LLVM-exception)") == ({"mit"}, 1.0)
    assert evaluate("MIT with LLVM-exception with SHL-2.0") == ({"mit+llvm-exception"}, 1.0)
    assert evaluate("MIT with LLVM-exception and (foo or ISC)") == ({"mit+llvm-exception", "foo", "isc"}, 1.0)


def test_bpe_against_the_library(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tabletidy.llm.bpe import bpe

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_padding(), lib.no_truncation()
    draw = random.Random(6)
    odd = [None, "", "  ", "ΑΣ ΟΔΟΣ", "İstanbul <|endoftext|>x <|startoftext|>", "e\u0301 á \x1c\x1fz\x85q", "x" * 3000, "aaaa" * 50, "don't I'LL we've 'sa 12½³", "日本語🙂🙂", "<|endoftext", "ǅ ŉ ẞ ﬁ"]
    odd += ["".join(draw.choices("aeinthsor'1 .éß\tÀ!?İ\u3000", k=200)) for _ in range(200)]
    texts = [*driver_texts().values(), *odd]
    got = {r["doc_id"]: r for r in bpe(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, text in enumerate(texts):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want
        assert got[i]["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_bpe_special_tokens_of_the_vocabulary(spark, tmp_path):
    """Special tokens are those that the vocabulary names, whatever they look like."""
    import json

    import public_tokenizers
    import pytest
    from tokenizers import Tokenizer

    from tabletidy.llm.bpe import Codec, bpe

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] += [{"id": 49408 + i, "content": c, **plain} for i, c in enumerate(["[SEP]", "[SEP]x", "pause"])]
    path = tmp_path / "special.json"
    path.write_text(json.dumps(spec))
    lib = Tokenizer.from_file(str(path))
    texts = ["a [SEP] b", "[SEP]xy", "Pause, pausepause a pause", "[sep] <|endoftext|>[SEP][SEP]x", "none here"]
    got = {r["doc_id"]: r for r in bpe(frame(spark, texts), str(path)).collect()}
    for i, text in enumerate(texts):
        want = lib.encode(text, add_special_tokens=False).ids
        assert got[i]["ids"] == want, text
        assert got[i]["decoded"] == lib.decode(want, skip_special_tokens=False)
    spec["added_tokens"][-1]["lstrip"] = True
    with pytest.raises(ValueError, match="pause"):
        Codec(spec)


def brute_warc(pages):
    import base64

    groups = {}
    for i, html in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    out = []
    for i, html in pages:
        payload = (html or "").encode()
        again = i != last[payload]
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", last[payload] if again else None))
    return sorted(out, key=repr)


def test_warc(spark, scratch):
    from tabletidy.llm import warc

    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = duckdb.sql(f"SELECT page_id, html FROM read_parquet('{SF}/pages.parquet')").fetchall()
    assert rows(warc.op8_warc(spark, SF), *names) == brute_warc(pages)
    odd = [(None, "a"), (None, "a"), (1, "a"), (2, "b"), (3, None), (4, ""), (5, "ü" * 70_000), (6, "b"), (6, "c"), (None, "z"), (7, "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(i, f"http://x/{i} \n", h, 9) for i, h in odd], "page_id long, url string, html string, payload_bytes int")
    warc.write_warc(df, f"file://{scratch}/w")
    back = warc.read_warc(spark, f"file://{scratch}/w", verify="true")
    got = back.select(warc.page_of(back.record_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(back.refers_to).alias("refers_to"))
    assert rows(got, *names) == brute_warc(odd)
    assert {bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()} == {h or "" for _, h in odd}
    long = back.where("payload_bytes > 1000 and record_type = 'response' and target_uri like 'http://x/%'")
    assert [len(r["payload"]) for r in long.collect()] == [140_000]
    assert back.where("record_type <> 'response'").count() == sum(r[3] == "revisit" for r in brute_warc(odd))
    empty = f"file://{scratch}/e"
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_warc_appends(spark, scratch):
    """Records of every job stay readable, a file of others beside them too; lost attempts are not read."""
    from tabletidy.llm import warc

    path = f"file://{scratch}/w"
    page = lambda i: spark.createDataFrame([(i, "u", f"text {i}", 6)], "page_id long, url string, html string, payload_bytes int")
    for i in (1, 2):
        warc.write_warc(page(i), path)
    with open(f"{scratch}/w/other.warc", "wb") as f:
        f.write(warc.record("urn:page:3", "response", "u", None, b"text 3"))
    with open(f"{scratch}/w/part-{'0' * 32}.warc.gz", "wb") as f:
        f.write(warc.member(warc.record("urn:page:4", "response", "u", None, b"lost")))
    assert rows(warc.read_warc(spark, path, verify="true"), "record_id", "payload") == [(f"urn:page:{i}", f"text {i}".encode()) for i in (1, 2, 3)]


def test_warc_of_others(spark, scratch):
    """Plain files, and gzip members without a length, are read as well; headers decide first."""
    import gzip

    from tabletidy.llm import warc

    plain = b"".join(warc.record(f"urn:page:{i}", "response", None, None, b"p" * i * 5000) for i in range(4))
    for name, data in (("a.warc", plain), ("b.warc.gz", b"".join(gzip.compress(warc.record(f"urn:page:{i}", "response", "u", None, b"q" * i * 9000)) for i in range(4)))):
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(data)
    back = warc.read_warc(spark, f"file://{scratch}", verify="true")
    assert rows(back, "record_id", "payload_bytes") == sorted((f"urn:page:{i}", i * n) for i in range(4) for n in (5000, 9000))
    m = warc.Member(open(f"{scratch}/a.warc", "rb"), 0)
    assert m.headers["warc-type"] == "response" and m.length > 0


SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def brute_secrets(text):
    spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind) for k, (kind, p, g, least) in enumerate(SECRETS) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    spans.sort()
    return *(sum(s[3] == kind for s in spans) for kind, *_ in SECRETS), sha(",".join(s[2] for s in spans)), [s[2] for s in spans]


def test_secret_scan(spark, scratch):
    from tabletidy.llm import secret_scan as S

    hexes = "0123456789abcdef" * 2
    odd = [None, "", "token=token:abcdef123", "🙂 PASSWORD : 'hunter22hunter' api_key=\"x\" APIKEY=abcdef", f"AKIA{'A' * 15} AKIA{'B' * 16}AKIA{'C' * 16} {hexes}", f"secret={hexes} g" + hexes, "ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "secret=abcdef " * 500, "secret=abcdef " * 500]
    texts = {**driver_texts(), **{10**6 + i: t for i, t in enumerate(odd)}}
    docs = frame(spark, list(texts.values()), list(texts))
    ledger = f"{scratch}/ledger"
    for _ in range(2):  # the second run finds every pair in the ledger
        got = {r["doc_id"]: r for r in S.secret_scan(docs, ledger).collect()}
        for i, text in texts.items():
            *counts, digest, base = brute_secrets(text)
            assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == counts and got[i]["base_sha256"] == digest, text
            assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
        assert got[10**6 + 6]["spans"].startswith("github:0:44") and got[10**6 + 7]["spans"] == "pem:0:31"
    seen = spark.read.parquet(f"{ledger}/seen")
    assert seen.count() == seen.distinct().count() == len({t or "" for t in texts.values()}) * len(S.BASE + S.MORE)
    S.scan(docs, ledger, (*S.BASE, S.Rule("pem", "BEGIN", version=2)))
    assert spark.read.parquet(f"{ledger}/seen").where("rule = 'pem@2'").count() == len({t or "" for t in texts.values()})
    assert S.secret_scan(frame(spark, []), f"{scratch}/none").collect() == []


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    import random

    from tabletidy.llm import quality_rules as R

    draw = random.Random(2)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(n))
    odd = [None, "", "  \n", "a " * 19, "a " * 20, "a b c d e f g h " * 9, "one two three four five six seven eight nine\n" * 2 + prose(60), "ü#*$%&|<> " + prose(30), prose(20), "🙂 " * 25]
    texts = {**driver_texts(), **{10**6 + i: t for i, t in enumerate(odd)}}
    clean = {2 * 10**6 + i: prose(draw.randint(30, 400)) for i in range(150)}
    junk = {3 * 10**6 + i: " ".join(w + "***" for w in prose(100).split()) for i in range(10)}
    texts |= clean | junk
    got = {r["_id"]: r for r in R.quality(frame(spark, list(texts.values()), list(texts))).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        want = brute_statistics(text)
        r = got[i]
        assert tuple(r[f"_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert all(got[i]["kept"] for i in clean) and not any(got[i]["kept"] for i in junk)
    docs = frame(spark, [*odd, *clean.values()])
    kept = R.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 150 + 3
    assert R.keep_good(frame(spark, [])).collect() == []


def test_moderate_outliers(spark):
    """Junk that is moderate in one statistic, or a little in three, goes; the clean documents stay."""
    import random

    from tabletidy.llm import quality_rules as R

    draw = random.Random(5)
    prose = lambda n, a=2, b=9: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(a, b))) for _ in range(n))
    clean = [prose(draw.randint(30, 400)) for _ in range(300)]
    passage = prose(26)
    symbols = lambda text, k: " ".join(w + "#" * (i < k) for i, w in enumerate(text.split()))
    junk = {
        "dup_lines": "\n".join([*(f"{prose(9)}\n{x}" for x in [prose(5)] * 31)]),
        "repeats": f"{passage} {prose(150)} {passage}",
        "symbols": symbols(prose(200), 60),
        "length": prose(200, 8, 11),
    }
    junk["three"] = "\n".join([f"{passage} {symbols(prose(60), 40)} {passage}", *(f"{prose(2)}\n{x}" for x in [prose(2)] * 31)])
    names = [*range(len(clean)), *range(10**6, 10**6 + len(junk))]
    got = {r["_id"]: r for r in R.quality(frame(spark, [*clean, *junk.values()], names)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] for i in range(len(clean)))
    assert {k: got[10**6 + i]["kept"] for i, k in enumerate(junk)} == dict.fromkeys(junk, False)


def test_rare_languages_are_judged(spark):
    """Every base-passing document gets a distance, in rare languages, small sources and tiny tables too."""
    import random

    from tabletidy.llm import quality_rules as R

    draw = random.Random(7)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(n))
    junk = lambda: " ".join(w + "***" for w in prose(100).split())
    data = [("en", "s", prose(100)) for _ in range(60)] + [("en", "t", junk()), ("en", "t", prose(100)), ("xx", "s", junk()), (None, "s", junk()), (None, None, prose(100))]
    table = lambda data: spark.createDataFrame([(i, t, a, b, len(t)) for i, (a, b, t) in enumerate(data)], DOCS)
    got = {r["_id"]: r for r in R.quality(table(data)).collect()}
    assert all(r["distance2"] is not None for r in got.values())
    assert sorted(i for i, r in got.items() if not r["kept"]) == [60, 62, 63]
    # many rare languages are pooled, apart from a large one that is unlike them
    long = lambda: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(12, 30))) for _ in range(100))
    data = [("en", "s", prose(100)) for _ in range(60)] + [(f"l{i % 9}", "s", long()) for i in range(60)] + [("l3", "s", junk())]
    got = {r["_id"]: r for r in R.quality(table(data)).collect()}
    assert [i for i, r in got.items() if not r["kept"]] == [120]
    assert [(r["kept"], r["distance2"] is not None) for r in R.quality(table(data[:1])).collect()] == [(True, True)]


def test_mcd_against_numpy(spark):
    """The estimate equals concentration steps written out in numpy, from the best of three starts."""
    import numpy as np

    from tabletidy.llm import quality_rules as R

    draw = np.random.default_rng(3)
    x = np.rint(draw.normal([15000, 500, 300, 4000], [1500, 900, 400, 3000], (400, 4))).astype(int)
    x[:60] += 40_000  # a far cluster that plain moments would follow
    floors = np.diag([(v * R.UNIT) ** 2 for v in R.FLOORS.values()])

    def steps(centre, scatter):
        best, before = (np.inf, None), np.inf
        while True:
            y = x - centre
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(scatter), y)
            bins = np.floor(np.log(d + 1e-6) * 64)
            edge = np.sort(bins)[int(np.ceil(len(x) * R.SHARE)) - 1]
            near = x[bins <= edge]
            centre, scatter = near.mean(0), np.cov(near.T, bias=True) * R.CONSISTENCY + floors
            now = np.linalg.slogdet(scatter)[1] / 2
            best = min(best, (now, centre), key=lambda v: v[0])
            if not now < before - R.STILL:
                return best
            before = now

    binned = np.rint(x / 100.0)
    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    mid = low(binned)
    mad = low(np.abs(binned - mid))
    reach = np.maximum(mad * 148.26, np.sqrt(np.diag(floors)))
    drawn = np.rint(mid * 100.0 + reach * np.tanh((x - mid * 100.0) / reach))
    starts = [(mid * 100.0, np.diag((mad * 148.26) ** 2) + floors), (x.mean(0), np.cov(x.T, bias=True) + floors), (drawn.mean(0), np.cov(drawn.T, bias=True) + floors)]
    best = min((steps(*s) for s in starts), key=lambda v: v[0])
    df = spark.createDataFrame([("g", len(x), *map(int, r)) for r in x], "_g string, n_all long, _length long, _symbols long, _repeats long, _dup_lines long")
    (row,) = R.estimates(df).collect()
    assert np.allclose([row[f"m_{n}"] for n in R.NAMES], best[1], rtol=1e-6)
    assert max(row[f"m_{n}"] for n in R.NAMES) < 20_000


def brute_classes(texts):
    """{id: (set size, smallest id of the component)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(min(a, b), max(a, b)) for v in holders.values() for k, a in enumerate(v) for b in v[:k]}
    for a, b in met:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(draw, n, words=120, edits=3):
    vocabulary = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(3000)]
    base = draw.choices(vocabulary, k=words)
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(words)] = draw.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def test_jaccard_brute_force(spark, monkeypatch):
    import random

    from tabletidy.llm import jaccard_join as J

    monkeypatch.setattr(J, "HOT", 20)  # salts and hubs at work on a small table
    monkeypatch.setattr(J, "HUB", 15)
    monkeypatch.setattr(J, "BLOCK", 8)
    draw = random.Random(1)
    odd = [None, "", " \n ", "one two", "ONE  two", "one two three four five", "One two three four five", "Ä b c d e", "ä b c d e", "x " * 3000, "x " * 10]
    passage = " ".join("".join(draw.choices("pqrst", k=5)) for _ in range(60))
    shared = [" ".join([passage, *("".join(draw.choices("uvwxyz", k=6)) for _ in range(draw.randint(5, 200)))]) for _ in range(60)]
    texts = [*driver_texts().values(), *odd, *near_copies(draw, 90), *near_copies(draw, 90, 200, 9), *shared]
    texts = {i * 3: t for i, t in enumerate(texts)}
    want = brute_classes(texts)
    monkeypatch.setattr(J, "ROUNDS", 1)  # the exact round must find what the near rounds did not
    docs = frame(spark, list(texts.values()), list(texts))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(docs).collect()} == want
    monkeypatch.setattr(J, "ROUNDS", 6)
    kept = J.keep_one(docs.unionByName(docs))  # every row twice
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i, (n, c) in want.items() if n and c == i] + [i for i, (n, _) in want.items() if not n] * 2)
    assert J.jaccard_classes(frame(spark, [])).collect() == []
    nulls = J.jaccard_classes(frame(spark, ["a b c d e f"] * 2 + ["q", None], [None, 7, None, None])).collect()
    assert sorted(rows_ for rows_ in ((r["n_shingles"], r["component_id"]) for r in nulls) if rows_[0] == 2) == [(2, 7), (2, 7)]


def brute_repeats(texts, width=100):
    """{id: (bytes, removed, spans, hash of the rest)} with a dictionary of all windows."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            window = raw[p : p + width]
            if window in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(window)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def test_suffix_array():
    import numpy as np

    from tabletidy.llm import suffix_array as S

    draw = np.random.default_rng(4)
    for case in range(300):
        t = draw.integers(0, draw.integers(1, 8), draw.integers(1, 120))
        t = np.tile(t[: max(1, len(t) // 5)], 6) if case % 3 == 0 else t
        order = S.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = S.common_prefixes(t.astype(np.uint8), order, 20)
        for a, b in zip(order[1:], order[:-1]):
            n = next((k for k in range(20) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 20)
            assert shared[a] == n


def test_suffix_array_with_few_digits(monkeypatch):
    import numpy as np

    from tabletidy.llm import suffix_array as S

    monkeypatch.setattr(S, "DIGITS", 4)
    draw = np.random.default_rng(5)
    for _ in range(100):
        t = draw.integers(0, 5, 200)
        t[100:160] = t[20:80]
        for depth in (3, 10, 30):  # the order is right for so many letters
            near = S.suffix_array(t, depth=depth).tolist()
            assert [t[i : i + depth].tolist() for i in near] == sorted(t[i : i + depth].tolist() for i in range(200))
        assert S.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("many", [10_000, 5])
def test_suffix_dedup_brute_force(spark, monkeypatch, many):
    import random

    from tabletidy.llm import queries
    from tabletidy.llm import suffix_dedup as D

    monkeypatch.setattr(D, "ANCHOR_SEGMENTS", many)
    monkeypatch.setattr(D, "FLUSH", 300)
    monkeypatch.setattr(D, "SHARD_BYTES", 20_000)
    draw = random.Random(3)
    letters = lambda n: "".join(draw.choices("abc déf🙂\0", k=n))
    passage = letters(150)
    odd = [None, "", "x", "a" * 99, "a" * 100, "a" * 1000, "ab" * 300, letters(500) * 2, passage, passage[:99], passage[1:], "ü" * 50, "ü" * 51]
    odd += [letters(draw.randint(0, 80)) + passage[draw.randint(0, 30) :] + letters(draw.randint(0, 80)) for _ in range(60)]
    odd += near_copies(draw, 40)
    texts = dict(enumerate([*list(driver_texts().values())[:120], *odd]))
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, list(texts.values()), list(texts)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_dedup(spark, "").collect()}
    assert got == brute_repeats(texts)


def test_suffix_dedup_edges(spark):
    import random

    from tabletidy.llm.suffix_dedup import suffix_dedup

    text = "".join(random.Random(7).choices("abcdefgh", k=300))
    got = suffix_dedup(frame(spark, [text, text, text, text[:200], text[:20] + text, None], [None, 5, 5, 9, 10, 1])).collect()
    gone = sorted(((r["doc_id"] or 99, sum(s["stop"] - s["start"] for s in r["spans"]), len(r["kept"])) for r in got))
    assert gone == [(1, 0, 0), (5, 0, 300), (5, 0, 300), (9, 200, 0), (10, 300, 20), (99, 300, 0)]
    assert suffix_dedup(frame(spark, [])).collect() == []


def brute_weights(tokens, target_entropy=None, max_repeats=None, budget=None):
    import math

    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def at(alpha):
        z = sum(x**alpha for x in p.values())
        return {s: x**alpha / z for s, x in p.items()}

    def value(alpha):
        w = at(alpha)
        if target_entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) - target_entropy
        size = budget or max(tokens[s] / w[s] for s in p)
        return max(size * w[s] / tokens[s] for s in p) - max_repeats

    low, high = 0.0, 1.0
    if value(0.0) <= 0:
        high = 0.0
    elif value(1.0) <= 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if value(mid) > 0 else (low, mid)
    return at(high), budget or max(tokens[s] / at(high)[s] for s in p)


@pytest.mark.parametrize("how", [{"max_repeats": 2.0}, {"target_entropy": 1.3}, {"max_repeats": 3.0, "budget": 9000}, {"target_entropy": 99.0, "budget": 4000}])
def test_mixing_brute_force(spark, how):
    import random

    from tabletidy.llm.mixing import mix_sources, mixture

    draw = random.Random(5)
    data, i = [], 0
    for source, n in (("big", 300), ("mid", 60), ("small", 12), (None, 30), ("empty", 3)):
        for _ in range(n):
            data.append((i, None if source == "empty" else "w " * draw.randint(0, 40) + str(i), "en", source, 3))
            i += 1
    data += [data[0], (None, "a null id", "en", "mid", 9)]
    docs = spark.createDataFrame(data, DOCS)
    tokens = {}
    words = {}
    for d, text, _, s, _ in data:
        tokens[s] = tokens.get(s, 0) + len((text or "").split())
        words[d, text, s] = words.get((d, text, s), 0) + len((text or "").split())
    weights, size = brute_weights(tokens, how.get("target_entropy"), how.get("max_repeats"), how.get("budget"))
    got = mixture(docs, block_tokens=200, **how).collect()
    taken = {}
    for r in got:
        taken.setdefault(r["_src"], []).append(r)
    longest = max(words.values())
    for s, share in weights.items():
        key = "{}" if s is None else f'{{"s":"{s}"}}'
        want, have = size * share, sum(r["n_tokens"] for r in taken.get(key, []))
        assert want - longest - 1 <= have <= want + 1e-3 * want + 1, (s, want, have)
        passes = round(want / tokens[s], 6)
        for epoch in range(int(passes)):
            assert len({(r["_id"], r["_mark"]) for r in taken[key] if r["epoch"] == epoch}) == sum(k[2] == s for k in words)
        assert max(r["epoch"] for r in taken[key]) <= int(passes) if taken.get(key) else True
        orders = [[r["block"] for r in sorted((r for r in taken.get(key, []) if r["epoch"] == e), key=lambda r: r["place"])] for e in (0, 1)]
        assert all(len(dict.fromkeys(o)) == sum(a != b for a, b in zip(o, [None, *o])) for o in orders)  # blocks stay together
    assert all(0 <= r["place"] <= 1 for r in got)
    if "budget" not in how:
        assert {r["_id"] for r in got} == {d[0] for d in data}
        again = mix_sources(docs, **how)
        assert again.columns == docs.columns and again.count() >= len(data)
    assert mixture(docs.limit(0)).collect() == []


def test_pipeline_brute_force(spark, scratch):
    """Each stage against its brute-force version on what the stage before it kept."""
    import os

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in P.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "bpe"]
    kept, before = docs, docs
    for k, (name, stage) in enumerate(P.STAGES):
        path = os.path.join(scratch, str(k))
        stage(spark, kept, SF).write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        old, new = before.collect(), kept.collect()
        if name != "bpe":
            assert kept.columns == columns
        if name == "quality rules":
            ids = {r["doc_id"] for r in new}
            for r in old:
                n, _, symbols, _, repeats = brute_statistics(r["text"])
                if n < 20 or 100 * repeats > 30 * n:
                    assert r["doc_id"] not in ids
                elif symbols == 0:
                    assert r["doc_id"] in ids
        elif name == "line dedup":
            assert [r["doc_id"] for r in sorted(new)] == [r["doc_id"] for r in sorted(old)]
            key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            held = {}
            for r in old:
                for line in r["text"].split("\n"):
                    if len(key(line)) >= 40:
                        held.setdefault(key(line), set()).add(r["doc_id"])
            for r in old:
                want = "\n".join(x for x in r["text"].split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == r["doc_id"])
                assert next(x for x in new if x["doc_id"] == r["doc_id"])["text"] == want
        elif name == "near duplicates":
            classes = brute_classes({r["doc_id"]: r["text"] for r in old})
            assert sorted(r["doc_id"] for r in new) == sorted(i for i, (n, c) in classes.items() if c == i or not n)
        elif name == "mixing":
            assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old}
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(P.vocabulary())
            texts = {r["doc_id"]: r["text"] for r in old}
            assert len(new) == len(old)
            for r in new:
                assert r["ids_sha256"] == sha(" ".join(map(str, lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)))
    assert P.run(spark, SF).count() == kept.count()


def test_clashing_extra_columns(spark):
    """Extra columns, also named like results or inner columns, disturb no operator; stages keep them."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from tabletidy.llm import bpe, exact_dedup, jaccard_join, license_scan, line_dedup, mixing, quality_rules, secret_scan, suffix_dedup

    names = "_id _text _pos _line _key _h1 _h2 _docs _stays _gone _drop_id _kept _n_lines _n_dropped n_words _n_words n sid label kept keep_id spans block epoch place _src _mark path blob ids decoded places d t start mark _row _sha _own _g score component_id _keep _its src tokens".split()
    texts = [*list(driver_texts().values())[:60], None, "", None]
    plain = frame(spark, texts, [*range(len(texts) - 1), None])
    docs = plain.select("*", *[F.lit(i).cast("string").alias(n) for i, n in enumerate(names)])
    for stage in (quality_rules.keep_good, line_dedup.drop_lines, jaccard_join.keep_one, mixing.mix_sources):
        out = stage(docs)
        assert out.columns == docs.columns
        assert rows(out, "doc_id", "text") == rows(stage(plain), "doc_id", "text")
        assert out.where("score = '0' or d is null").count() == 0
    for scan in (exact_dedup.exact_dedup, license_scan.license_scan, secret_scan.secret_scan, jaccard_join.jaccard_classes, suffix_dedup.suffix_dedup, lambda x: bpe.bpe(x, public_tokenizers.path("word_bpe_49k.json"))):
        assert scan(docs).count() == len(texts)
    assert mixing.mixture(docs).count() == mixing.mixture(plain).count()
