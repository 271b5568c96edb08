"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweir.llm import decontaminate, graph, near_dup, pii, quality_model, quality_rules, repeats, sentencepieces, token_count, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 4), (4, LONG, "en", "a", 1), (5, LONG, "en", "a", 1), (5, LONG, "en", "a", 1), (6, f"one {PASSAGE} two", "en", "b", 1),
    (7, f"three four {PASSAGE}", None, "b", 1), (8, "Mixed CASE five words here", "en", None, 1), (9, "mixed case five words here", "en", "b", 1), (10, "too few", "en", "b", 1), (11, "Too FEW", "en", "b", 1),
    (None, f"no id {PASSAGE}", "en", "b", 1), (12, "a a a a a a a a a a a a", "en", "b", 1), (13, "mail x.y@mail.example.com or call +1 (555) 010-9999 from 10.0.0.255", "en", "b", 1), (14, "ünïcödé ß 日本語 \U0001f600 card 4111 1111 1111 1111", "en", "b", 1), (15, "it's we'll <|endoftext|> they've  \n done", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those of the operators."""
    d = spark.createDataFrame(ODD, SCHEMA)
    for c in ("score", "kept", "component_id", "found", "high", "rep", "digest", "token_ids", "host", "m", "w", "x", "label_id"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# Each operator with the arguments that it needs beside documents: none may fail on odd or empty tables.
def _all(spark, d):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string")
    return {
        "leaks": decontaminate.find_leaks(d, bench), "pii": pii.find_pii(d), "rules": quality_rules.host_rules(d), "near": near_dup.near_duplicates(d), "repeats": repeats.remove_repeats(d),
        "tokens": token_count.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), "toxic": toxicity.score(d, toxicity.fit(d, labels)), "quality": quality_model.score_quality(d, labels), "pieces": sentencepieces.verify(d, public_tokenizers.path("piece_bpe_32k.model")),
    }


def test_odd_rows(spark, odd):
    for name, out in _all(spark, odd).items():
        rows = out.collect()
        assert name == "leaks" or len(rows) == len(ODD), name
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()} == {(6, 1), (7, 1), (None, 1)}


def test_empty_tables(spark, odd):
    for name, out in _all(spark, odd.where("false")).items():
        assert out.count() == 0, name


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def test_pii(odd, docs):
    rng = np.random.default_rng(3)
    letters = np.array(list("a@.1023-+ ()Z%é"))
    for _ in range(4000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    for frame in (odd, docs):
        want = collections.Counter()
        for i, t in texts_of(frame):
            b = brute_spans(t or "")
            want[i, *(sum(s[2] == k for s in b) for k in pii.BASE), hashlib.sha256(pii.spans_text(b).encode()).hexdigest()] += 1
        got = pii.find_pii(frame).collect()
        assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    model = pii.fit(docs)
    assert [k for _, _, k in pii.spans_of("login with token = 'a8f3c9e17b2d4f60a8f3' and (212) 555-0198, mail x@y.org", model)] == ["secret", "phone", "email"]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(odd, model).collect()}
    assert masked[13] == "mail [EMAIL] or call [PHONE] from [IP]" and masked[1] is None


def test_pii_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.candidates(t, pii.base_spans(t))


def test_pii_takes_whole_runs():
    key, local = "aB3" * 400, "first.last" * 20
    t = f"token: {key}.x, secret='{key}' mail {local} (at) example (dot) org"
    assert [t[s:e] for s, e, _ in pii.candidates(t, [])] == [f"{key}.x,", key, f"{local} (at) example (dot) org"]
    for t in ("token=" + "a1" * 100_000, "a-" * 100_000 + "=", "token:" * 50_000, "a" * 200_000 + " (at) ", "a(at)b.c" * 50_000, "=aaaaaaa" * 30_000):
        pii.candidates(t, [])


def test_pii_listed_names(spark):
    t = "contact Mary Smith or John O'Brien-Jones, then Dr. Anna Berg; Mary said Johnson Smith"
    assert [t[s:e] for s, e, k in pii.candidates(t, []) if k == "person"] == ["Mary Smith", "John O'Brien-Jones", "Anna Berg", "Johnson Smith"]
    d = spark.createDataFrame([(i, t) for i in range(5)] + [(9, "Mary said so")], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask(d, pii.fit(d)).collect()}
    assert masked[0] == "contact [PERSON] or [PERSON], then Dr. [PERSON]; Mary said Johnson Smith" and masked[9] == "Mary said so"


# Sentences with spans that are personal data, between angle brackets, and such that only look like it, between braces.
PLANTED = {
    "secret": (["token = <%h>", "login with password: <%m> today", 'the api_key="<%m>" works', "bearer: <%h>", "set secret=<ghp_%m>"], ["commit: {%h} was fine", "see file: {report-2024-final.pdf} now", "a note: {remember} this", "sha256={%h}", "model: {%m} sold out", "at path={some-long-path/part-12} here"]),
    "person": (["contact <Mary %n> for it", "told <John %n>, who", "Dr. <%n %n> came", "by <Anna %n> in may", "asked <Peter %n>, said"], ["in {New %n} it rains", "near {%n Street} we met", "the {%n University} grew", "At last {%n %n} River rose", "visit {Los %n} soon"]),
    "phone": (["call (<%a) %a-%d>", "phone <%a-%a-%d> please", "tel <%a.%a.%d> or", "mobile: <%a %a %d>"], ["isbn {978-0-%d-12}", "on {2024-01-15} we", "order {%d-%d-%d}", "version {10.20.30.40.50}", "total {12 34 56 78} points"]),
    "ssn": (["ssn <%a-45-%d> on file", "social security <%a-12-%d>"], ["part no {000-12-%d} in stock", "order {987-00-%d} shipped", "item {900-11-0000} sold"]),
    "email": (["mail <j.%w (at) %w (dot) org> now", "write to <%w7 [at] %w.com> or", "contact <%w_x at %w dot net> for"], ["look {here at example.xyz} for", "we {meet at noon.then} go", "it {was at rest.Nothing} moved"]),
}


def planted(rng, n):
    """Texts with the spans that are true and false in them."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, rng.integers(4, 9)))
    fill = {"%h": lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), "%m": lambda: "".join(rng.choice(list("ABCDEFGHJKabcdefghjk23456789"), 20)), "%n": lambda: word().capitalize(), "%a": lambda: str(rng.integers(201, 899)), "%d": lambda: str(rng.integers(1000, 9999)), "%w": word}
    out = []
    for i in range(n):
        text, spans = "", []
        for kind in rng.permutation(list(PLANTED)):
            right = bool(rng.integers(2))
            sentence = str(rng.choice(PLANTED[kind][1 - right]))
            sentence = re.sub("%[hmnadw]", lambda m: fill[m.group()](), sentence)
            start = len(text) + re.search("[<{]", sentence).start()
            end = len(text) + re.search("[>}]", sentence).start() - 1
            spans.append((kind, start, end, right))
            text += re.sub("[<>{}]", "", sentence) + f" {word()} {word()}. "
        out.append((i, text, spans))
    return out


def test_pii_labelers_disagree_and_learning_decides(spark):
    """Precision and recall of each kind on texts that the model was not fitted on; no single labeler does it alone."""
    train, test = planted(np.random.default_rng(21), 400), planted(np.random.default_rng(22), 300)
    model = pii.fit(spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string"))
    hit, found, real = collections.Counter(), collections.Counter(), collections.Counter()
    patterns = collections.Counter()
    for _, t, spans in test:
        got = [s for s in pii.spans_of(t, model)]
        patterns.update(pii.votes(t, s) for s in pii.candidates(t, pii.base_spans(t)))
        for kind, s, e, right in spans:
            covered = any(k == kind and a < e and s < b for a, b, k in got)
            real[kind] += right
            hit[kind] += right and covered
            found[kind] += covered
    assert len(patterns) >= 12 and sum(0 in v and 1 in v for v in patterns) >= 4
    for kind in PLANTED:
        assert hit[kind] / real[kind] >= 0.9 and hit[kind] / max(1, found[kind]) >= 0.9, (kind, hit[kind], found[kind], real[kind])


def test_pii_reliabilities_come_from_disagreement():
    """A labeler that votes against the others is found to be unreliable, and its votes no longer decide."""
    rng = np.random.default_rng(5)
    counts = collections.Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        good = [int(true if rng.random() < 0.9 else not true) for _ in range(3)]
        counts[(pii.ORDER["secret"], *good, int(rng.random() < 0.5), 1, 0)] += 1
    r = pii.SpanModel(counts).reliability[pii.ORDER["secret"]]
    assert (abs(r[:3] - 0.9) < 0.05).all() and (abs(r[3] - 0.5) < 0.08).all()


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates(spark, odd, docs):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(150)]
    family = []
    for n in range(400):  # a family whose members differ more and more: many links fail
        w = list(base)
        for k in rng.choice(150, n // 14, replace=False):
            w[k] = f"n{rng.integers(1 << 30)}"
        family.append((n, " ".join(w)))
    for frame in (odd.where("doc_id IS NOT NULL"), docs, spark.createDataFrame(family, "doc_id long, text string")):
        want = brute_components(texts_of(frame))
        got = near_dup.near_duplicates(frame).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_sketches_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    for same in (800, 760, 700):
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, 800 - same, dtype=np.uint64)])
        x, y = near_dup.odd_sketches(near_dup.signatures([np.sort(a), np.sort(b)])).view(np.uint64)
        z = int(np.bitwise_count(x ^ y).sum())
        differing = -near_dup.BITS / 2 * np.log(1 - 2 * z / near_dup.BITS) / 2
        assert abs(differing / near_dup.SAMPLES - (1 - same / (1600 - same))) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def test_repeats(odd, docs):
    for frame in (odd.where("doc_id IS NOT NULL"), docs):
        rows = texts_of(frame)
        first = {}
        for i, t in sorted(rows):
            w = words(t)
            for s in range(len(w) - 49):
                first.setdefault(tuple(w[s : s + 50]), i)
        want = collections.Counter()
        for i, t in rows:
            w = words(t)
            keep = [True] * len(w)
            for s in range(len(w) - 49):
                if first[tuple(w[s : s + 50])] < i:
                    keep[s : s + 50] = [False] * 50
            kept = [x for x, k in zip(w, keep, strict=True) if k]
            want[i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
        assert collections.Counter(map(tuple, repeats.remove_repeats(frame).collect())) == want


def test_rules(spark, odd, docs):
    import duckdb

    for frame in (odd.where("doc_id IS NOT NULL"), docs):
        pdf = frame.select("doc_id", "text", "source").toPandas().drop_duplicates().astype({"doc_id": "int64"})
        con = duckdb.connect()
        con.register("documents", pdf)
        want = con.execute(quality_rules.ORACLE).fetchall()
        columns = [d[0] for d in con.description]
        got = quality_rules.host_rules(frame.select("doc_id", "text", "source").dropDuplicates()).select(*columns).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_host_verdicts_decide(spark):
    """Equal documents fare differently on a good, a doubtful and a bad host; a host with few documents is shrunk to the mean."""
    clean = "one of several ordinary sentences with enough words to pass all of the rules"
    loud = "SHOUTING " * 3 + "ONE OF SEVERAL SENTENCES WITH ENOUGH WORDS TO PASS THE BASE RULES"
    rows = [(h, t) for h, n_loud, n in (("good", 1, 200), *((f"other{k}", k % 3, 100) for k in range(25)), ("doubtful", 40, 200), ("bad", 190, 200), ("tiny", 1, 2)) for t in [loud] * n_loud + [clean] * (n - n_loud)]
    d = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {(r["host"], r["failed"]): (r["kept"], r["host_distrusted"], r["host_rejected"]) for r in quality_rules.host_rules(d).collect()}
    assert got["good", True] == (True, False, False) and got["doubtful", True] == (False, True, False) and got["doubtful", False] == (True, True, False)
    assert got["bad", False] == got["bad", True] == (False, True, True)
    assert got["tiny", False][0] and not got["tiny", False][2]
    alone = quality_rules.host_rules(d.where("source = 'doubtful'")).where("kept").count()
    assert alone == 200  # one host is its own mean


def test_host_verdicts_change_rows(docs):
    """On the test table some documents stay that fail further rules, and some go."""
    got = quality_rules.host_rules(docs).where("failed AND NOT base_failed").groupBy("kept").count().collect()
    assert len(got) == 2


def test_token_counts(odd, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for frame in (odd, docs):
        want = collections.Counter((i, len((t or "").encode()), n, n > 512) for (i, t) in texts_of(frame) for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
        assert collections.Counter(map(tuple, token_count.count_tokens(frame, path).collect())) == want
    rng = np.random.default_rng(9)
    letters = np.array(["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "a", "1", "!", "é", "²", "日", " ", "　", "<|endoftext|>", "\x1c", "\x85", "\U0001f600"])
    random_texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    assert token_count.TokenCounter(path).count(random_texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in random_texts]


def test_token_tables_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_count, "MOST_KNOWN", 3)
    monkeypatch.setattr(token_count, "MOST_STATES", 3)
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    c, library = token_count.TokenCounter(path), Tokenizer.from_file(path)
    texts = ["several different words here", "and other ones there", "several different words here"]
    assert [c.count([t])[0] for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_archives(spark):
    big = "<p>" + "same page " * 30
    rows = [(1, "http://a/ b", big), (2, "http://b/", big), (3, None, None), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "", "WARC/1.1\r\n\r\n\r\n\r\n" * 9), (7, "http://e/é", "é" * 50), (8, "http://f", "é" * 50), (None, "http://g", big), (2, "http://b/", big)]
    got = sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((k for k, _, h in rows if h == html and k is not None), default=i)
        revisit = len(raw) >= 100 and i is not None and first < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(map(str, want))
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_written_archives_can_be_sought(spark, tmp_path):
    """Each record is a gzip member of its own; revisits name the record that they repeat."""
    import gzip
    import zlib as z

    big = "<p>" + "same page " * 30
    rows = [(1, "http://a/", big, None, None), (2, "http://b/", big, 1, "http://a/"), (3, "http://c/", "x", None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long, refers_url string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(warc.convert(warc.to_arc(d)), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    found = []
    while data:
        one = z.decompressobj(31)
        made = one.decompress(data)
        found += list(warc.parse_warc(made))
        assert len(list(warc.parse_warc(made))) == 1
        data = one.unused_data
    assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "response", "revisit", "response"]
    assert found[2][0]["WARC-Refers-To"] == found[1][0]["WARC-Record-ID"] and found[2][0]["WARC-Refers-To-Target-URI"] == "http://a/"
    assert found[1][1] == warc.http_block(big.encode()) and found[2][1] + big.encode() == found[1][1]
    huge = warc.member(b"a" * (17 << 20))
    assert huge[-1] == 0 and gzip.decompress(huge) == b"a" * (17 << 20)


def test_arc_versions():
    for version in (1, 2):
        made = warc.arc_file("x.arc", version, [("http://a/", b"one\n\nfiledesc://"), ("http://b/", b"")])
        (info, _), *found = warc.parse_arc(made)
        assert info["url"] == "filedesc://x.arc" and info["version"] == str(version)
        assert [p for _, p in found] == [b"one\n\nfiledesc://", b""] and [f["url"] for f, _ in found] == ["http://a/", "http://b/"]
        assert ("sum" in found[0][0]) == (version == 2)
        with pytest.raises(ValueError, match="length"):
            list(warc.parse_arc(warc.arc_file("x.arc", version, [("http://a/", b"12345678")])[:-5]))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.parse_arc(b"no\n"))
    with pytest.raises(ValueError, match="version 7"):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 20240101000000 text/plain 4\n7 0\n"))


def test_arcs_made_by_hand():
    """Records as crawlers wrote them: HTTP heads of both line ends, a name look-up, spaces in a URL and a content type, short dates."""
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\nContent-Type: text/html\r\n\r\n<html>one</html>"
    bare = b"HTTP/1.0 404 Not Found\nServer: y\n\ngone\n\naway"
    dns = b"20010101000000\nhost.example 60 IN A 192.0.2.7\n"
    one = b"1 0 Some Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    two = b"2 0 Some Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v1 = b"filedesc://old.arc 0.0.0.0 19990203 text/plain %d\n%s\n" % (len(one), one) + b"http://host.example/a b 192.0.2.7 19990203040506 text/html; charset=x %d\n%s\n" % (len(page), page) + b"dns:host.example 192.0.2.1 19990203040500 text/dns %d\n%s\n" % (len(dns), dns)
    v2 = b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc %d\n%s\n" % (len(two), two) + b"http://host.example/c 2001:db8::1 200101010203 text/html 404 abc - 170 new.arc %d\n%s\n" % (len(bare), bare)
    first, second = ([next(warc.parse_warc(r)) for r in warc.converted(v)] for v in (v1, v2))
    assert [f["WARC-Type"] for f, _ in first] == ["warcinfo", "response", "resource"] and [f["WARC-Type"] for f, _ in second] == ["warcinfo", "response"]
    assert first[0][0]["WARC-Filename"] == "old.arc" and first[0][0]["WARC-Date"] == "1999-02-03T00:00:00Z" and b"ARC version 1" in first[0][1]
    f, block = first[1]
    assert block == page and f["Content-Type"] == warc.HTTP and f["WARC-Target-URI"] == "http://host.example/a b" and f["WARC-IP-Address"] == "192.0.2.7"
    assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<html>one</html>").hexdigest() and f["WARC-Date"] == "1999-02-03T04:05:06Z"
    f, block = first[2]
    assert block == dns and f["Content-Type"] == "text/dns"
    f, block = second[1]
    assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"gone\n\naway").hexdigest() and f["WARC-IP-Address"] == "2001:db8::1" and f["WARC-Date"] == "2001-01-01T02:03:00Z"
    assert f["WARC-Record-ID"] == warc.record_id("http://host.example/c", f["WARC-Date"], hashlib.sha256(b"gone\n\naway").hexdigest())


@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("toxic", "toxic", 4, 2), ("quality", "quality", 5, 0)])
def test_held_out(spark, name, label, modulus, held):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    make = (lambda x, y: toxicity.score(x, toxicity.fit(x, y))) if name == "toxic" else quality_model.score_quality
    got = {r["doc_id"]: r for r in make(d, labels).collect()}
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) for i, r in got.items())
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    pos = np.array([r["score"] for i, r in got.items() if r["held_out"] and y.get(i) == 1])
    neg = np.array([r["score"] for i, r in got.items() if r["held_out"] and y.get(i) == 0])
    assert (pos[:, None] > neg[None]).mean() > 0.9
    flipped = labels.withColumn(label, F.when(toxicity.remainder("doc_id", modulus) == held, 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    again = {r["doc_id"]: r["score"] for r in make(d, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())  # held-out labels change nothing


def test_pieces(spark, odd, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = sentencepieces.PieceEncoder(path)
    for frame in (odd, docs):
        rows = sentencepieces.verify(frame, path).collect()
        assert all(r["word_parity"] and r["round_trip"] for r in rows)
        assert all(r["parity"] for r in sentencepieces.whole_text_parity(frame, path).collect())
        texts = [t or "" for _, t in texts_of(frame)]
        assert e.encode(texts) == e.reference(texts)
    back = sentencepieces.decode_documents(sentencepieces.encode_documents(docs, path), path)
    assert {tuple(r) for r in back.select("doc_id", "text").collect()} == set(texts_of(docs))


def test_pieces_of_whole_texts():
    """Ids of whole texts are the library's: with repeated markers and long runs, and where the rebuilt tokenizer is wrong."""
    e = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(12)
    parts = np.array(["▁", "▁▁", " ", "   ", "a", "the", "word", "\n", "é", "日本", "<s>", "</s>", "<0x41>", "=" * 70, "a" * 300, "-", "1234567", "\U0001f600"])
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)] + [" " * 5000, "▁" * 3000, "x" * 20_000, "ab " * 5000]
    agreed = lambda texts: [x.tolist() for x in np.split(*(lambda ids, at: (ids, at[1:-1]))(*e.agreed(texts)))]
    assert agreed(texts) == e.reference(texts)

    class Wrong:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            return self.tokenizer.encode_batch_fast([t.replace("strange", "strong") for t in texts], **options)

    e.tokenizer = Wrong(e.tokenizer)
    texts = ["a strange word", "a word", "strange", ""]
    e.forget()
    assert e.encode(texts) != e.reference(texts) and agreed(texts) == e.reference(texts)
    ids, at, back, same = e.encode_flat(texts)
    assert same.tolist() == e.compared(texts, ids, at)[0].tolist() == [False, True, False, True] and back.tolist() == same.tolist()


def test_pieces_table_may_be_emptied(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_WORDS", 3)
    monkeypatch.setattr(sentencepieces, "JOINED", 2)
    e = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["several different words here", "and other ones  there", "several different words here", "\x00a b"]
    assert [e.encode([t])[0] for t in texts] == e.reference(texts)


def _message(*fields):
    """A protobuf message of (number, value) with integers, floats or bytes."""
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4])
            while value > 127:
                out, value = out + bytes([value & 127 | 128]), value >> 7
            out += bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2])
            n = len(value)
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            out += bytes([n]) + value
    return out


def test_unigram_model(tmp_path):
    """A small unigram model, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("▁th", -4.0), ("▁the", -4.5), ("e", -3.5), ("r", -3.6), ("er", -4.1), ("▁there", -7.5), ("a", -3.3), ("re", -4.2), ("▁a", -3.9), *((c, -6.0) for c in "<>/sunk0x41"))]
    model = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces) + _message((2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "u.model"
    path.write_bytes(model)
    e = sentencepieces.PieceEncoder(str(path))
    texts = ["there are", "  the   a ", "a there therea", "x é", "<s> <0x41>"]
    assert e.model.kind == sentencepieces.UNIGRAM and e.encode(texts) == e.reference(texts)


def test_lcs():
    assert decontaminate.lcs([1, 2, 3, 4], [9, 1, 3, 3, 4, 2]) == 3 and decontaminate.lcs([1], []) == 0


def test_paraphrases(spark, docs):
    rng = np.random.default_rng(2)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    made, want = [], set()
    for r in bench.collect():
        w = r["text"].split()
        if len(w) >= 20:
            for k in rng.choice(len(w), len(w) // 8, replace=False):
                w[k] = "changed"
            made.append((1_000_000 + r["item_id"], " ".join(["before"] * 40 + w + ["after"] * 70)))
            want.add((1_000_000 + r["item_id"], r["item_id"]))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(both, bench).collect()}
    assert len(want & got) >= 0.95 * len(want)
    flat = lambda t: " " + re.sub(r"[.,;:!?](?= )", "", " ".join((t or "").lower().split()) + " ")
    items = {r["item_id"]: flat(r["text"]) for r in bench.collect()}
    exact = {(i, k) for i, t in texts_of(docs) for k, x in items.items() if x in flat(t)}
    assert exact <= got and len({g for g in got - exact if g[0] < 1_000_000}) <= len(exact)


def test_widespread_items(spark):
    """An item in a third of short documents, and one of words that all texts have, are found in each."""
    rng = np.random.default_rng(4)
    item = " ".join(f"leak{i}" for i in range(40))
    frequent = " ".join(f"common{i}" for i in rng.permutation(60)[:40])
    rows = []
    for i in range(600):
        own = [f"common{k}" for k in rng.permutation(60)] + [f"own{i}x{k}" for k in range(20)]
        rows.append((i, " ".join(own + ([item] if i % 3 == 0 else []) + ([frequent] if i % 50 == 1 else []))))
    bench = spark.createDataFrame([(1, item), (2, frequent)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {(i, 1) for i in range(0, 600, 3)} | {(i, 2) for i in range(1, 600, 50)} <= got
    assert {g for g in got if g[1] == 1} == {(i, 1) for i in range(0, 600, 3)}


def _topics(rng, n):
    """Texts of one topic each, whose words are common in it, and rare words; items are such texts that no row holds."""
    return [[f"t{t}x{k}" for k in rng.integers(0, 25, 40)] + [f"rare{rng.integers(1 << 40)}" for _ in range(20)] for t in rng.integers(0, 8, n)]


def test_rare_words_changed(spark):
    """Paraphrases whose rare words are all changed have little of the weight: only the latent space finds them."""
    rng = np.random.default_rng(6)
    items = [[w for pair in zip(x[:20], x[20:40], x[40:], strict=True) for w in pair] for x in _topics(rng, 12)]
    rows = [(i, " ".join(rng.permutation(x))) for i, x in enumerate(_topics(rng, 800))]
    rows += [(1000 + i, " ".join(w if not w.startswith("rare") else f"new{i}x{k}" for k, w in enumerate(x))) for i, x in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1000 + i, i) for i in range(len(items))}


def test_directions_are_those_of_the_passages(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(x[:32]) for x in _topics(rng, 500)]
    idf = np.ones(decontaminate.DIMS)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums, df, n = decontaminate.statistics(frame)
    assert n == len(texts) and df.sum() == sum(len(np.unique(decontaminate.Items([(0, t)]).hashes >> np.uint64(49))) for t in texts)
    v = decontaminate.directions(frame, idf, sums)
    a = decontaminate.Items([(i, t) for i, t in enumerate(texts)]).vectors(idf, 0, len(texts)) / np.sqrt(32)
    exact = np.linalg.svd(a, full_matrices=False)[2][:8]
    assert v.shape == (decontaminate.DIMS, decontaminate.RANK) and (np.linalg.norm(exact @ v, axis=1) > 0.99).all()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert sorted(after.columns) == sorted(docs.columns)
        sizes.append(after.count())
        before = after
    assert docs.count() > sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > 100
    assert set(before.columns) == {"doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens"}
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows and ids, clashing columns, and on an empty table."""
    import corpus_pipeline

    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    clash = odd.union(odd.limit(1).withColumn("doc_id", F.lit(5).cast("long")).withColumn("text", F.lit("another text under an id that repeats")))
    for c in ("gone_id", "leaked_id", "n_tokens", "GONE_ID_"):
        clash = clash.withColumn(c, F.lit("clash"))
    for frame in (clash, clash.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path / "sf"))
            n = out.count()
            if name != "sentencepiece":
                assert out.columns == frame.columns
            if name in ("pii", "sentencepiece"):
                assert n == frame.count()
            assert n <= frame.count()
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, clash, "").collect()}
    assert 8 in left and 9 not in left and {1, 2, 3, None} <= left
    assert {r["doc_id"] for r in corpus_pipeline.drop_benchmark_leaks(spark, clash, str(tmp_path / "sf")).collect()}.isdisjoint({6, 7})


def test_rows_that_repeat_an_id(spark):
    """Different texts under one id: one row out for each row in, and the links of all of them count."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(5, text(1)), (5, text(2)), (3, text(1)), (4, text(2)), (7, text(3)), (7, text(3)), (8, text(4)), (8, text(5))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(d).collect())
    assert got == {(5, 3): 2, (3, 3): 1, (4, 3): 1, (7, 7): 2, (8, 8): 2}
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(d).collect())
    assert got == {(5, 60, 60): 2, (3, 60, 0): 1, (4, 60, 0): 1, (7, 60, 0): 2, (8, 60, 0): 2}
    rows = [(5, "alone " + text(1)), (5, "free " + " ".join(f"q{i}" for i in range(70))), (3, text(1) + " end")]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(5, 61, 60): 1, (5, 71, 0): 1, (3, 61, 0): 1}


def test_automata_lead_to_occurrences(spark, odd, monkeypatch):
    """Without phrases in the automata nothing is found, and with one that finds every place nothing more."""
    import ahocorasick

    def removed(passages):
        stretch = {"doc_id": [9], "high": [1], "low": [2], "start": [7], "words": [list(range(1000, 1200))]}
        t = repeats.pa.table({k: repeats.pa.array(v, repeats.pa.list_(repeats.pa.int64()) if k == "words" else repeats.pa.int64()) for k, v in stretch.items()})
        p = repeats.pa.table({"first_doc": repeats.pa.array([x for x, _ in passages], repeats.pa.int64()), "words": repeats.pa.array([w for _, w in passages], repeats.pa.list_(repeats.pa.int64()))})
        return [(r["from"], r["to"]) for r in repeats._locate(p, t).to_pylist()]

    hidden = [7] * 10 + list(range(1030, 1100)) + [8] * 10
    assert removed([(3, hidden)]) == [(37, 107)] and removed([(9, hidden)]) == removed([(3, hidden[:59])]) == []
    monkeypatch.setattr(repeats, "automaton", lambda words, offsets: ahocorasick.Automaton())
    assert removed([(3, hidden)]) == []


def test_patterned_words_hash_apart():
    """Long words of two letters in a pattern that cancels out in sums of powers, and word sequences of that kind."""
    from logweir.llm import common

    pattern = np.array([bin(i).count("1") % 2 for i in range(4096)])
    x, y = ("".join(np.where(pattern == k, "a", "b")) for k in (0, 1))
    (_, _, w), = common.chunks(repeats.pa.array([f"{x} {y}", " ".join(x), " ".join(y)]))
    high, low = w.whole()
    assert w.hashes[0] != w.hashes[1] and high[1] != high[2] and low[1] != low[2]
    data = np.frombuffer(b"a" * 1_000_000 + b" b", np.uint8)
    assert common.spans_hash(data, np.array([0, 1_000_001]), np.array([1_000_000, 1_000_002]))[1] == common.spans_hash(data[-1:], np.array([0]), np.array([1]))[0]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from logweir.llm import common

    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="shared|share"):
        common.shared_dir(Bare)


def _labelled(spark, n=60):
    rng = np.random.default_rng(31)
    common = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [str(w) for w in rng.choice(common, rng.integers(5, 30))] + (["vile!", "Nasty", f"odd{i % 3}"] if toxic else ["kind", "gentle."])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_word_evidence_is_that_of_a_plain_model(spark):
    """Class-conditional chances with shared continuation counts, word by word with dictionaries."""
    d, labels, rows, marks = _labelled(spark)
    fold = {r["doc_id"]: r["fold"] for r in d.selectExpr("doc_id", "CAST(pmod(xxhash64(doc_id, 7), 2) AS int) AS fold").collect()}
    train = d.join(labels, "doc_id").withColumn("fold", F.expr("CAST(pmod(xxhash64(doc_id, 7), 2) AS int)"))
    got = {r["key"]: r for r in toxicity.word_evidence(train).collect()}
    counts = {k: collections.Counter() for k in (0, 1)}
    halves = {(f, k): collections.Counter() for f in (0, 1) for k in (0, 1)}
    follows = collections.defaultdict(set)
    for (i, t), (_, _, toxic) in zip(rows, marks, strict=True):
        before = None
        for w in t.lower().split():
            w = w[:-1] if w[-1] in ".!" and len(w) > 1 else w
            counts[toxic][w] += 1
            halves[fold[i], toxic][w] += 1
            follows[w].add(before)
            before = w
    frequent = [w for w in counts[1] if counts[1][w] >= toxicity.LEAST_WORDS]
    kinds = sum(len(follows[w]) for w in frequent)

    def chance(c, w):
        known = {x: n for x, n in c.items() if x in frequent}
        return (max(c[w] - 0.75, 0) + 0.75 * len(known) * len(follows[w]) / kinds) / sum(known.values())

    assert len(got) == len(frequent) >= 20
    (_, _, hashed), = toxicity.chunks(repeats.pa.array([" ".join(frequent)]))
    for w, h in zip(frequent, repeats.signed(toxicity.word_hashes(hashed)), strict=True):
        r = got[int(h)]
        assert r["n"] == counts[0][w] + counts[1][w]
        assert abs(r["both"] - np.log(chance(counts[1], w) / chance(counts[0], w))) < 1e-4
        assert abs(r["fold1"] - np.clip(np.log(chance(halves[1, 1], w) / chance(halves[1, 0], w)), -8, 8)) < 1e-4


def test_word_evidence_beyond_the_bound_stays_in_a_table(spark, odd, monkeypatch):
    """Scores and kept rows are the same with all evidence in every task and with most of it in a table."""
    d, labels, _, _ = _labelled(spark)
    d = d.withColumn("row", F.lit("clash"))
    d = d.union(d.limit(3)).union(spark.createDataFrame([(None, "vile nasty words", "x"), (70, None, "x"), (71, "", "x")], "doc_id long, text string, row string"))
    whole = toxicity.fit(d, labels)
    monkeypatch.setattr(toxicity, "MOST_KNOWN", 8)
    some = toxicity.fit(d, labels)
    assert whole.rest is None and 0 < some.rest.count() and len(some.known.keys) <= 8
    show = lambda f: sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 6), r["predicted"]) for r in f.collect())
    assert show(toxicity.score(d, whole)) == show(toxicity.score(d, some))
    kept = lambda m: sorted(map(str, toxicity.keep_ordinary(d, m).collect()))
    assert kept(whole) == kept(some) and 0 < len(kept(some)) < d.count()


def test_letter_model_is_a_plain_one():
    """log_ratios against the same model over dictionaries of sequences."""
    rng = np.random.default_rng(3)
    counts = np.zeros((2, toxicity.CODES))
    seqs = rng.integers(0, toxicity.SIGNS, (300, toxicity.ORDER)) % 5
    for s in seqs:
        counts[rng.integers(2), int("".join(f"{x:05b}" for x in s), 2)] += rng.integers(1, 4)
    got = toxicity.log_ratios(counts)
    present = {c for c in np.flatnonzero(counts.sum(0))}

    def split(code, order):
        return tuple(code >> (5 * k) & 31 for k in reversed(range(order)))

    grams = [{split(c, 4) for c in present}]
    for _ in range(3):
        grams.append({g[1:] for g in grams[-1]})
    continuation = [collections.Counter(g[1:] for g in grams[k]) for k in range(3)]  # orders 3, 2, 1

    def shared(g):
        if not g:
            return 1 / toxicity.SIGNS
        c = continuation[3 - len(g)]
        of = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        total = sum(of.values())
        return (max(c[g] - 0.75, 0) + 0.75 * len(of) * shared(g[1:])) / total if total else shared(g[1:])

    by = [{split(c, 4): n for c, n in enumerate(row) if n} for row in counts]
    for g in list(grams[0])[:40]:
        p = []
        for c in by:
            of = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
            weight = sum(min(n, 1) for n in of.values()) + toxicity.STRENGTH
            n = c.get(g, 0)
            p.append((n - min(n, 1) + weight * shared(g[1:])) / (sum(of.values()) + toxicity.STRENGTH))
        assert abs(got[int("".join(f"{x:05b}" for x in g), 2)] - np.log(p[1] / p[0])) < 1e-4


def test_additive_scores_are_sums_of_table_entries():
    """A row's score from its bins, one by one."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, len(quality_model.MEASURES))).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400)) > 0).astype(float)
    m = quality_model.AdditiveModel(x, y, rounds=20, pair_rounds=10)
    place = lambda edges, v: sum(e < v for e in edges)
    for row, got in zip(x[:50], m.scores(x[:50]), strict=True):
        total = m.bias + sum(t[place(m.edges[i], row[i])] for i, t in enumerate(m.tables))
        total += sum(v[place(m.coarse[i], row[i]), place(m.coarse[j], row[j])] for i, j, v in m.pairs)
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9
    assert len(m.pairs) == quality_model.PAIRS and ((m.scores(x) > 0.5) == y).mean() > 0.75


@pytest.mark.parametrize("name", ["op3_host_quality_rules", "op4_odd_sketch_near_dup", "op5_repeated_phrase_automata", "op7_arc_to_warc"])
def test_queries_against_sql(spark, name):
    import duckdb

    from logweir.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(tuple(map(str, r)) for r in want.fetchall()) == sorted(tuple(map(str, r)) for r in got.collect())


def test_leaks_against_brute_force(spark, docs):
    """Recall of the candidate search: every passage of every document with every item, by subsequences alone."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = np.random.default_rng(17)
    made = []
    for r in bench.collect()[::2]:  # paraphrases of all degrees
        w = r["text"].split()
        for share in (0.1, 0.2, 0.3):
            v = [x if rng.random() > share else f"other{rng.integers(1 << 30)}" for x in w]
            made.append((1_000_000 + len(made), " ".join([f"a{i}" for i in range(int(rng.integers(0, 90)))] + v + [f"b{i}" for i in range(50)])))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in bench.collect() if r["text"]])
    want = set()
    for i, t in texts_of(both):
        for _, _, w in decontaminate.chunks(repeats.pa.array([t or ""]), lower=True):
            h = decontaminate.word_hashes(w).tolist()
            for at in range(0, len(h), decontaminate.BLOCK):
                near = h[max(0, at - decontaminate.BLOCK) : at + 3 * decontaminate.BLOCK]
                known = set(near)
                for k in range(len(items.ids)):
                    words = items.words(k)
                    if sum(x in known for x in words) >= decontaminate.LCS * len(words) and decontaminate.lcs(words, near) >= decontaminate.LCS * len(words):
                        answer = words[-decontaminate.ANSWER_WORDS :]
                        if decontaminate.lcs(answer, near) >= decontaminate.ANSWER * len(answer):
                            want.add((i, int(items.ids[k])))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(both, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 40, (len(got), len(want))


def test_long_texts_take_little_memory():
    """Peak bytes for each byte of one long text in the passes over texts."""
    import tracemalloc

    rng = np.random.default_rng(1)
    t = " ".join(f"w{x}" for x in rng.integers(0, 1 << 20, 500_000))
    pa = repeats.pa
    plain = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [t]})
    trained = pa.RecordBatch.from_pydict({"text": [t], "toxic": pa.array([1], pa.int32()), "fold": pa.array([0], pa.int32())})
    fixed = 16 * 8 * toxicity.CODES  # tables of fixed size
    for run, batch in ((near_dup._sign, plain), (repeats._survey, plain), (toxicity._count, trained), (toxicity._word_counts, trained)):
        tracemalloc.start()
        list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak - fixed < 40 * len(t), (run, peak / len(t))


def test_tasks_give_back_what_they_free():
    """In a process of their own, as in a worker: after a pass hardly any freed memory is left that the allocator could give back."""
    import subprocess
    import sys

    code = r"""
import ctypes, re
import numpy as np, pyarrow as pa
from logweir.llm import near_dup, pii, sentencepieces, toxicity
import public_tokenizers
def anonymous():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
rng = np.random.default_rng(3)
texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 20, 300)) for _ in range(6000)]
plain = pa.RecordBatch.from_pydict({"doc_id": list(range(6000)), "text": texts})
trained = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array([1, 0] * 3000, pa.int32()), "fold": pa.array([0] * 6000, pa.int32())})
del texts
trim = ctypes.CDLL(None).malloc_trim
sentencepieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
for run, batch in ((near_dup._sign, plain), (toxicity._count, trained), (toxicity._word_counts, trained), (toxicity._before(np.ones(1 << 24, np.uint8)), trained.select(["text"])), (pii._counts, plain.select(["text"]))):
    trim(0)
    for out in run(iter([batch])):
        pass
    del out
    held = anonymous()
    trim(0)
    print(run.__qualname__, round(held - anonymous(), 1), len(sentencepieces._encoders))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout
    found = [line.rsplit(" ", 2) for line in out.splitlines()]
    assert len(found) == 5 and all(float(mb) < 6 and kept == "0" for _, mb, kept in found), out
