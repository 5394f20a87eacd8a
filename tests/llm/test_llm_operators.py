"""Each operator against a brute-force version, on a small fixture that holds the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from granary.llm import decontam, line_dedup, pii, quality, sharding, simhash, toxicity, warc
from granary.llm.bpe_codec import encode_documents
from granary.llm.bytebpe import default_path
from granary.llm.token_counts import Counter, count_tokens


def collected(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


STRANGE = ["", "a<|endoftext|>b", "<|endo", "it's  2 \n\n x", "\x1c\x85 \xa0", "😀é漢​", " the  THE the", "\x00", "don'T 've"]


def test_codec_equals_library(spark, odd, library):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, s) for i, s in enumerate(STRANGE)], "doc_id long, text string"))
    got = collected(encode_documents(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")
    want = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(back), back] += 1
    assert got == want
    assert encode_documents(odd.limit(0)).count() == 0


def test_counts_equal_library(spark, odd, library):
    want = collections.Counter()
    for r in odd.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 1024] += 1
    assert collected(count_tokens(odd), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_chunk_maps_compose(library):
    counter, draw = Counter(default_path()), random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "<|endoftext|>", "é", "12", "the", " The", "!", "漢"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        for size in (1, 2, 3, 7, 100):
            assert counter.count(text, size) == want
        maps = [counter.chunk(text[i : i + 3]) for i in range(0, len(text), 3)]
        if maps:
            last = counter.scan(maps)[-1]
            assert counter.plain(last.head) + (last.inner or 0) + counter.plain(last.tail) == want


def brute_pii(text):
    text, out, n = text or "", [], [0] * 4
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, (name, p) in enumerate(zip(("email", "ip", "card", "phone"), patterns)):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and (not 14 <= len(digits) <= 19 or total % 10) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            n[k] += 1
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return (*n, sha(",".join(x for *_, x in sorted(out))))


def test_pii(spark, odd):
    draw = random.Random(3)
    parts = [*"0123456789" * 2, " ", "-", ".", "+", "(", "@", "a", "é", "😀", "\n", "%", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 555 123 4567"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(800)] + ["1" * 40_000, "a@" + "b." * 9_000, "x" * 40_000, None, ""]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = collections.Counter((r["doc_id"], *brute_pii(r["text"])) for r in df.collect())
    assert collected(pii.find_personal_data(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    more = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 and ssn 123-45-6789; DE00 3704 0044 0532 0130 00, 123-45-6789")], "doc_id long, text string")
    assert pii.find_personal_data(more).first()["spans"].startswith("iban:5:32,ssn:")


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits += [h >> k & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def test_simhash(spark, odd):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in odd.select("doc_id", "text").collect()]
    codes, root = sorted({f for _, f in rows}), {}
    for f in codes:
        near = [g for g in codes if (f ^ g).bit_count() <= 3]
        for g in near:
            a, b = root.get(f, f), root.get(g, g)
            root = {**root, f: a, g: b}
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = collections.Counter((i, f"{f:016x}", least[root[f]]) for i, f in rows)
    assert collected(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4, 10_000])
def test_tree_search_finds_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    draw = random.Random(5)
    codes = set()
    for _ in range(30):
        c = draw.getrandbits(64)
        for _ in range(12):
            codes.add(c)
            for _ in range(draw.randint(0, 3)):
                c ^= 1 << draw.randrange(64)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.near_edges(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    top = {c: c for c in signed}

    def find(x, t):
        while t[x] != x:
            x = t[x]
        return x

    for r in edges:
        assert (((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count()) <= 64
        top[find(r["a"], top)] = find(r["b"], top)
    want = {c: c for c in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                want[find(a, want)] = find(b, want)
    same = lambda t: {frozenset(c for c in signed if find(c, t) == r) for r in {find(c, t) for c in signed}}
    assert same(top) == same(want)


def test_quality(spark, odd, labels):
    extra = [(50, "a b c a b c a b " + "z " * 60), (51, "one two # three $ | four\n\none two # three $ | four\n" * 9), (52, "word | word && " * 40)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = collections.Counter()
    for r in df.collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality.judge_quality(df, labels)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    assert quality.judge_quality(odd, labels).count() == odd.count()
    assert quality.judge_quality(odd.limit(0), labels.limit(0)).count() == 0


def test_decontamination(spark, odd):
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id < 6").collect()}
    items = [(1, " ".join(texts[1].split()[5:25])), (2, " ".join(texts[1].split()[20:29]).upper()), (3, "word1"), (4, texts[2].split()[7]), (5, None), (6, ""), (None, texts[4])]
    items += [(7, " ".join(texts[3].split()[0:3])), (7, " ".join(texts[3].split()[0:3])), (8, " ".join(texts[5].split()[-8:]) + " tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 7)):
                windows[tuple(w[k : k + 8])].add(i)
    want = collections.Counter()
    for r in odd.collect():
        w, hit, found = words(r["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        want[r["doc_id"], len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(found) >= 2] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(decontam.find_benchmark(odd, bench), *columns) == want
    assert decontam.find_benchmark(odd, bench.limit(0)).count() == odd.count()
    assert decontam.find_benchmark(odd.limit(0), bench).count() == 0


def test_sharding(spark, odd):
    many = odd.select("doc_id", "text").union(spark.range(3000).selectExpr("id + 100", "CASE WHEN id % 3 = 0 THEN 'copy of one text' ELSE repeat('ab', id % 97) END"))
    got = sharding.shard_by_bytes(many).toPandas()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in many.collect())
    ids = [None if x != x else int(x) for x in got["doc_id"]]
    assert collections.Counter(zip(ids, got["size"], got["text_crc32"])) == want
    for _, shard in got.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    small = sharding.shard_by_bytes(many.where("doc_id >= 100")).toPandas().groupby("shard")["size"].sum()
    assert len(small) == 40 and small.max() - small.min() <= 2 * 250
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def test_edit_similarity():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    draw = random.Random(1)
    for _ in range(500):
        a, b = ([draw.choice(b"abcd") for _ in range(draw.randint(0, 12))] for _ in range(2))
        assert line_dedup.edit_similarity(a, b) == pytest.approx(1 - distance(a, b) / max(len(a), len(b), 1))


def test_line_dedup(spark, odd):
    base = ["alpha beta gamma delta epsilon zeta eta theta", "short line", "one two three four five six seven eight nine ten"]
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "\n".join(base)), (2, "Alpha, BETA gamma delta epsilon zeta eta theta!\nshort line\nnew words that nobody has written before"), (3, base[2] + "\n\n" + base[2]), (4, near), (5, near + " n60"), (6, None), (6, ""), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [(i, h, k, line_dedup.normalised(x)[0]) for i, t in rows for h, k, x in ((0, k, x) for k, x in enumerate((t or "").split("\n")))]
    lines = sorted(((-1 if i is None else i), k, w) for i, _, k, w in lines if w)
    group = list(range(len(lines)))
    for a, (*_, u) in enumerate(lines):
        for b, (*_, v) in enumerate(lines):
            if u == v or line_dedup.edit_similarity(u, v) >= 0.8:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    gone = {lines[i][:2] for i, g in enumerate(group) if g != i}
    want = collections.Counter()
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (-1 if i is None else i, k) not in gone]
        want[i, None if t is None else "\n".join(kept)] += 1
    got = line_dedup.dedup_lines(df).selectExpr("row.doc_id", "text", "n_removed")
    assert collected(got, "doc_id", "text") == want
    done = line_dedup.dedup_lines(odd)
    assert done.count() == odd.count() and done.select("row.*").columns == odd.columns
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_toxicity_holds_out_and_ranks(spark, odd, labels):
    draw = random.Random(4)
    ordinary = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [draw.choice(ordinary) for _ in range(40)]
        if toxic:
            words[draw.randrange(40)] = draw.choice(["idiotic", "scummy", "trashy", "moronic"])
            words[draw.randrange(40)] = draw.choice(["idiotic", "scummy", "trashy", "moronic"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"]))
    held = got[got["held_out"]]
    toxic = held["doc_id"] % 6 == 0
    assert (held[toxic]["predicted"] == 1).mean() > 0.9 and (held[~toxic]["predicted"] == 0).mean() > 0.97
    wrong = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, y) for i, y in marks]
    again = toxicity.score_toxicity(docs, spark.createDataFrame(wrong, "doc_id long, toxic int")).toPandas()
    assert (again.sort_values("doc_id")["score"].to_numpy() == got.sort_values("doc_id")["score"].to_numpy()).all()
    few = toxicity.score_toxicity(odd, labels).toPandas()
    assert len(few) == odd.count() and few["score"].between(0, 1).all()
    assert toxicity.score_toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_isotonic_is_monotone():
    score, label = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    x, y = toxicity.isotonic(score, label)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[-1] > 0.9


def test_warc(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title><script>var a='</p>';</script></head><body><p>One <b>two</b></p><!-- <p>no</p> --><a href='/x?a=1&amp;b=2'>link</a><br>1 < 2<p>unclosed"
    title, text, links = warc.read_html(html)
    assert (title, links) == ("A & B", ["/x?a=1&b=2"])
    assert text == "One two\nlink\n1 < 2\nunclosed"
    pages = spark.createDataFrame([(1, "http://a/", html), (1, "http://a/", html), (2, None, None), (None, "u", "")], "page_id long, url string, html string").selectExpr("*", "'z' AS payload", "'y' AS block")
    made = warc.build_derivatives(warc.responses_from_pages(pages), id_col="page_id").collect()
    assert collections.Counter(r["warc_type"] for r in made) == {"metadata": 4, "conversion": 4}
    for r in made:
        assert r["content_length"] == len(r["block"]) and r["block_digest"] == warc.digest(bytes(r["block"]))
        assert r["refers_to"].startswith("<urn:uuid:") and r["refers_to"] != r["record_id"]
    assert {r["block"].decode() for r in made if r["warc_type"] == "conversion" and r["page_id"] == 1} == {text}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html.encode()
    record = {"warc_type": "response", "record_id": "<urn:uuid:1>", "target_uri": "http://a/", "warc_date": "2024-01-01T00:00:00Z", "content_type": "application/http; msgtype=response", "block": http}
    (tmp_path / "a.warc.gz").write_bytes(warc.serialise(record) + warc.serialise(record | {"record_id": "<urn:uuid:2>"}))
    back = warc.read_responses(spark, str(tmp_path / "a.warc.gz"))
    assert {r["record_id"] for r in back.collect()} == {"<urn:uuid:1>", "<urn:uuid:2>"}
    assert {bytes(r["payload"]) for r in back.collect()} == {html.encode()}
    derived = warc.build_derivatives(back).collect()
    assert len(derived) == 4 and derived[0]["source_headers"][0]["name"] == "Content-Type"
    assert warc.build_derivatives(back.limit(0)).count() == 0
