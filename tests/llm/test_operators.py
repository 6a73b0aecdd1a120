"""Each operator against brute force on a small table with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import bytehash, jpeg, lines, minhash, pieces, quality, secrets, shared, stages, suffixes, templates, tokens, warc
from tidemark.llm import words as kept_words
from tidemark.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, tag string, score string, keep int, node string, n long, spans string, _whole int, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts():
    rng = random.Random(3)
    words = ["the", "of", "Éte", "ü!", "stone,", "river", "AKIA", "b", "night.", "x9", "ｗ", "plain", "hill", "cloud"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
    base = say(120)
    near = base.split(" ")
    near[40:42] = ["other"]
    half = base[: len(base) // 2] + say(60)
    common = ["  A Common LINE\t", "a common line", "\x0bA common line"]
    out = [None, "", " ", "\n", "one", "two words", base, base, " ".join(near), half, base.upper(), say(4000), "ab" * 300, "é" * 150]
    out += [f"{say(12)}\n{rng.choice(common)}\n{say(9)}\n\n{rng.choice(common)}" for _ in range(14)]
    out += ['password = "hunter22x" and TOKEN:abc api_key=ABCDEF.12 secret: token = "abcdef1"', "AKIA" + "Q7" * 9 + " " + "deadbeef" * 4, "tökén token=éabcdef passwd:'zzzzzz'", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(n, t) for n, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(n, t, "t", "s", 1, "n", 2, "x", 3, len(t or "")) for n, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, a repeated id with another text, and a repeated row."""
    return spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "g h i j k l"), (None, None)], "doc_id long, text string")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_tokens(docs, none, odd, rows, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    library = tokens.WordEncoder.of(path).library
    got = {r.doc_id: r for r in tokens.token_records(docs, path).collect()}
    start = 0
    for n, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[n])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_records(none, path).count() == 0
    assert sorted(r.start for r in tokens.token_records(odd, path).collect())[0] == 0 and tokens.token_records(odd, path).count() == 5


def test_word_encoder_equals_library():
    encode = tokens.WordEncoder(vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    made = ["".join(rng.choice("abAÉé'\"(<|>*-.,!9 \ńsSt") for _ in range(50)) for _ in range(400)] + ["a<|endoftext|>b <|STARTOFTEXT|>", "⦀ x⦀", "İstanbul ΣΑΣ"]
    assert encode(pa.array(made)) == encode.whole(made)


def test_damaged_record_is_refused(docs, tmp_path):
    shards = tokens.write_tokens(docs, vocabulary("word_bpe_49k.json"), 1, f"file://{tmp_path}/t")
    name = next((tmp_path / "t").glob("*.bin"))
    data = bytearray(name.read_bytes())
    data[20] ^= 1
    name.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        tokens.read_tokens(docs.sparkSession, f"file://{tmp_path}/t", shards).collect()


def shingle_set(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size):
    sets = {n: shingle_set(t, size) for n, t in rows}
    comp = {n: n for n in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return sets, comp


@pytest.mark.parametrize("size", [4, 5])
def test_minhash(docs, none, odd, rows, size):
    sets, comp = components(rows, size)
    got = minhash.near_duplicates(docs, size, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {n: (len(sets[n]), comp[n], comp[n] == n) for n in sets}
    if size == 5:
        assert minhash.near_duplicates(none, size, 80).count() == 0
        assert sorted((r.doc_id is None, r.component_id) for r in minhash.near_duplicates(odd, size, 80).collect() if r.n_shingles) == [(False, 5), (False, 5), (False, 5), (True, 5)]


def near_texts(rng, n, width, most):
    """Near copies at many distances of one text."""
    base = [str(rng.random()) for _ in range(width)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(width)] = str(rng.random())
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("outside", "family", "stars"), [(1 << 20, 1 << 20, 4), (9000, 12_000, 1), (1500, 3000, 0)])
def test_families_in_blocks_and_parts(spark, monkeypatch, outside, family, stars):
    """Blocks of a few nodes, further stars, and families split by further keys: no link is lost."""
    monkeypatch.setattr(minhash, "_STARS", stars)
    monkeypatch.setattr(minhash, "_LARGE", 1 if outside < 9999 else 32)
    monkeypatch.setattr(minhash, "_OUTSIDE", outside)
    monkeypatch.setattr(minhash, "_FAMILY", family)
    rows = near_texts(random.Random(8), 60, 80, 6)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == components(rows, 4)[1]


def test_signatures_near_the_threshold(spark):
    """Of pairs at 80 to 82 %, all signatures lie within the distance that the index covers."""
    rng, pairs = np.random.default_rng(4), 4000
    found, owner = [], []
    for k in range(pairs):
        n = int(rng.integers(40, 400))
        differ = int(n * (1 - 0.8) / (1 + 0.8))  # of each side
        both = rng.integers(0, 2**63, n - differ, np.uint64)
        for side in range(2):
            own = np.concatenate([both, rng.integers(0, 2**63, differ, np.uint64)])
            found.append(own)
            owner.append(np.full(n, 2 * k + side))
    sig = minhash.signatures(np.concatenate(found), np.concatenate(owner), 2 * pairs)
    differ = (sig[::2] != sig[1::2]).sum(1)
    assert differ.max() <= minhash.MOST
    keys = next(iter(minhash._key_rows([pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), minhash._binary(sig[:2000])], names=["node", "sig"])])))
    keys = keys.column("key").to_numpy().reshape(2000, 64)
    assert (keys[::2] == keys[1::2]).any(1).all()


def test_many_nodes_of_one_key_stay_linear(spark):
    """20,000 near copies in one family: rows of blocks follow the family's size."""
    n = 20_000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(10).cast("long").alias("n"), F.lit(bytes(128)).alias("sig"))
    sets = nodes.select("node", F.lit(bytes(80)).alias("shingles"))
    rest = nodes.select(F.lit(1).alias("family"), "node", "n", F.when(F.col("node") < 50, F.col("node")).otherwise(50).alias("comp"), F.lit(50).cast("long").alias("main"), F.lit(n * 280).alias("bytes"), F.lit(50 * 280).alias("outside"))
    links = minhash._Links(nodes, sets, 80)
    seen = []
    made = links.blocks.__func__
    old, minhash.written = minhash.written, lambda df, label: seen.append(df) or df
    try:
        edges = made(links, rest)
    finally:
        minhash.written = old
    assert edges.count() >= 50
    assert "CartesianProduct" not in seen[0]._jdf.queryExecution().toString()


#: The contract's expressions, in its own words, and the least lengths of what is tested; then the further kinds.
WORDING = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]


def brute_secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(WORDING) for m in re.finditer(p, text) if len(m[group]) >= least)


def test_secrets(docs, none, odd, rows, monkeypatch):
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    named = lambda s: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in s)
    for n, t in rows:
        found = brute_secrets(t or "")
        assert got[n].spans == named(found), t
        assert got[n].base_sha256 == sha(named([f for f in found if secrets.RULES[f[1]].base]))
        assert got[n].n_assign == sum(k == 0 for _, k, _ in found)
    assert secrets.secret_report(none).count() == 0 and secrets.secret_report(odd).count() == 5
    monkeypatch.setattr(secrets, "SMALL", 0)
    assert {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()} == {n: r.spans for n, r in got.items()}
    assert secrets.trigram_query("[0-9a-f]+") is True and secrets.trigram_query("abc|bcd") == ("or", "abc", "bcd")


def test_trigram_index(docs, rows):
    """Posting blocks list exactly the texts that hold a trigram; candidates are those whose lists satisfy the query."""
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    wanted = sorted(set().union(*map(secrets.trigrams, queries.values())))
    index = secrets.write_index(docs, wanted)
    names = {r.number: r.doc_id for r in index.rows.collect()}
    held = {}
    for r in index.postings.collect():
        for word, bits in r.words:
            held.setdefault(r.trigram, set()).update(names[word * 64 + b] for b in range(64) if bits >> b & 1)
    assert held == {g: ids for g in wanted if (ids := {n for n, t in rows if g in (t or "").lower()})}
    assert index.postings.groupBy("trigram", "block").count().where("count > 1").count() == 0

    def holds(query, text):
        return True if query is True else query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])

    may = {r.doc_id: r.asDict() for r in secrets.candidates(index).collect()}
    for n, t in rows:
        for kind, query in queries.items():
            if query is not True:
                assert may.get(n, {}).get(f"may_{kind}", False) == holds(query, (t or "").lower())


def test_pieces(docs, none, odd, rows):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: tuple(r)[1:] for r in pieces.piece_report(docs, path).collect()}
    for n, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[n] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))
    assert pieces.piece_report(none, path).count() == 0 and pieces.piece_report(odd, path).count() == 5


def test_agenda_equals_library():
    model = pieces.PieceModel(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(2)
    made = ["".join(rng.choice("ab cé\n\t  ▁ü日🙂.,!'09<s>THe\x85") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    made += ["x" * 50, "ab" * 100, "   ", "a  \n\n b ", "🙂" * 40]
    ids = model.encode(pa.array(made))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == model.library.encode(made, add_bos=True, add_eos=True)
    assert model.decode(ids) == model.library.decode(model.library.encode(made))
    words = [w for w in {x for t in made for x in t.split()} if w]
    ids, ends = model.agendas([f" {w}" for w in words])
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [model.agenda(f"▁{w}") for w in words]


def test_kept_words_begin_anew():
    calls = []

    def encode(words):
        calls.append(len(words))
        data = "".join(w[::-1] for w in words).encode()
        return np.frombuffer(data, np.uint8), np.cumsum([len(w) for w in words])

    kept = kept_words.Kept(encode, 10)
    rng = random.Random(3)
    for n in (5, 40_000, 3, 60_000):
        made = [str(rng.randrange(90_000)) for _ in range(n)]
        data, ends = kept.codes(pa.array([w.encode() for w in made]))
        assert data.tobytes() == "".join(w[::-1] for w in made).encode() and np.diff(ends).tolist() == [len(w) for w in made]
    assert len(calls) > 4 and kept.codes(pa.array([], pa.binary()))[1].tolist() == [0]


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines(docs, none, odd, rows, keep):
    seen = {}
    for n, t in rows:
        for k in (t or "").split("\n"):
            seen.setdefault(line_key(k), set()).add(n)
    common = {k for k, v in seen.items() if len(v) >= 10 and k}
    got = {r.doc_id: tuple(r)[1:] for r in lines.line_report(docs, lines.line_bitmaps(docs, 10, 1, keep)).collect()}
    assert common
    first = set(common) if keep == "first" else set()
    for n, t in rows:
        own, stay = (t or "").split("\n"), []
        for x in own:
            if line_key(x) in common and line_key(x) not in first:
                continue
            first.discard(line_key(x))
            stay.append(x)
        assert got[n] == (len(own), len(own) - len(stay), sha("\n".join(stay)))
    assert lines.line_report(none, lines.line_bitmaps(none)).count() == 0
    assert lines.line_report(odd, lines.line_bitmaps(odd, 1)).where("n_dropped = 1").count() == 4


def test_line_runs_over_tasks(spark):
    """A line of all documents, dealt over many tasks."""
    made = spark.createDataFrame([(n, f"same\nown {n}\nSAME ") for n in range(300)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.line_report(made, lines.line_bitmaps(made, 250)).groupBy("n_dropped").count().collect()
        assert [tuple(r) for r in out] == [(2, 300)]
        few = lines.line_report(made, lines.line_bitmaps(made, 301)).groupBy("n_dropped").count().collect()
        assert [tuple(r) for r in few] == [(0, 300)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_warc(spark):
    big, small = "<p>" + "é" * 600 + "</p>", "<p>x</p>"
    made = [(1, "http://a/\r\nX: y", big), (2, None, big), (7, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "y" * 1000)]
    got = {r.page_id: tuple(r)[1:] for r in warc.capture_report(spark.createDataFrame(made, "page_id long, url string, html string").withColumn("tag", F.lit("t"))).collect()}
    for n, _, html in made:
        data = (html or "").encode()
        again = html == big and n != 7
        assert got[n] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None)
    assert warc.capture_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "\r\n\r\nWARC/1.0\r\n"), (2, "http://b/", "z" * 3_000_000)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    rows = warc.transactions(warc.read_archives(spark, folder, warc.write_archives(pages, folder))).collect()
    assert {r.metadata.page_id: bytes(r.response.payload).decode() for r in rows} == {r.page_id: r.html for r in pages.collect()}
    assert all(r.request.uri == r.response.uri for r in rows)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffixes(docs, none, odd, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.span_report(docs, 100).collect()}
    seen = set()
    for n, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[n] == (len(data), int(gone.sum()), runs, sha(np.frombuffer(data, np.uint8)[~gone].tobytes())), n
    if hot > 2:
        assert suffixes.span_report(none).count() == 0 and suffixes.span_report(odd).count() == 5


def test_suffix_pieces_and_join(spark, monkeypatch):
    """Long texts in pieces, and samples that outgrow the bitmap."""
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    monkeypatch.setattr(suffixes, "BITS", 8)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    made = [(1, base), (2, "zz" + base[1000:3000] + "q"), (3, base[:99] + "!" + base[200:300])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.span_report(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (2000, 1), 3: (100, 1)}


@pytest.mark.parametrize("slice_", [7, 1 << 16])
def test_levels_halve(monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "_SLICE", slice_)
    text = np.frombuffer("".join(f"{n:05d}" for n in range(400)).encode(), np.uint8)
    levels = suffixes.Levels(5)
    for k in range(8):
        starts = np.arange(k, 80, 8) * 5
        levels.add(text.copy(), starts)
    data, starts = levels.arrays[0]
    assert len(levels.arrays) == 1 and [data[a : a + 5].tobytes().decode() for a in starts] == [f"{n:05d}" for n in range(80)]
    assert levels.holds(np.array([b"00005", b"00081"])).tolist() == [True, False]


def test_suffix_array_is_lexicographic():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000).astype(np.uint8)  # zero bytes too
    at, family = np.arange(2900), np.sort(rng.integers(0, 5, 2900))
    order, same = suffixes.suffix_array(data, at, family, 7)
    keys = [(int(f), data[a : a + 7].tobytes(), a) for f, a in zip(family, at.tolist(), strict=True)]
    assert [keys[i] for i in order] == sorted(keys)
    assert same.tolist() == [k > 0 and keys[i][:2] == keys[j][:2] for k, (i, j) in enumerate(zip(order, [0, *order[:-1]], strict=True))]


@pytest.mark.parametrize("batch", [3, 4096])
def test_families_over_batches(spark, monkeypatch, batch):
    """Families that go on over many batches."""
    monkeypatch.setattr(suffixes, "_BATCH", batch)
    rng = random.Random(6)
    core = "".join(rng.choice("abcdefgh ") for _ in range(90))
    made = []
    for n in range(40):
        left, right = "".join(rng.choice("xy") for _ in range(rng.randint(1, 7))), "".join(rng.choice("zw") for _ in range(rng.randint(1, 7)))
        made.append((n, f"{n:03d}" * 40 + left + core + right + "".join(rng.choice("pqrst") for _ in range(60))))
    seen, want = set(), {}
    for n, t in made:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            gone[i : i + 100] |= t[i : i + 100] in seen
            seen.add(t[i : i + 100])
        want[n] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in suffixes.span_report(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()}
    assert got == want and len({w for w in want.values() if w}) > 2


def test_quality(spark, none):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "hill", "the", "of"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["RIVER!!", "BUY!!", "the***", "NOW!!"]) for _ in range(40))
    made = [(n, good() if n % 3 else bad()) for n in range(400)] + [(900, ""), (901, None)]
    docs = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(400)] + [(5000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    held = [n for n in range(400) if zlib.crc32(str(n).encode()) % 5 == 0]
    assert sum((out[n] >= 0.5) == (n % 3 > 0) for n in held) >= 0.95 * len(held)
    assert out[900] == out[901] == pytest.approx(model.prior)
    assert stages.keep_good(docs, labels).columns == docs.columns
    empty = quality.fit(none, labels)
    assert quality.with_scores(docs, empty).where("score = 0.5").count() == len(made) and quality.with_scores(none, empty).count() == 0


def test_templates(spark, none):
    items = spark.createDataFrame([(1, "A train covers 120 miles in 3 hours while Anna reads 40 pages and then 120 more miles go by"), (2, "short one"), (3, None), (4, "the quick stone rolled under seven green hills beside a very old river")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Intro. A train covers 120 miles in 3 hours while Anna reads 40 pages and then 120 more miles go by. End."),
        (11, "a train covers 75 km in 9 hours while Peter reads 12 pages, and then 75 more km go by"),
        (12, "a train covers 75 km in 9 hours while Peter reads 12 pages and then 99 more km go by"),
        (13, "THE QUICK stone rolled under seven green hills, beside a very old river!"), (14, "the quick stone rolled away from seven hills"), (15, None), (16, ""),
    ], "doc_id long, text string")
    for small in (4_000_000, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, items, small=small).collect()}
        assert got == {(10, 1): "verbatim", (11, 1): "changed", (13, 4): "verbatim"}
    assert templates.leaks(none, items).count() == 0 and templates.leaks(docs, items.limit(0)).count() == 0


def test_templates_opening_names_and_joined_units(spark):
    items = spark.createDataFrame([
        (1, "Tom has 5 red apples in his bag. Tom gives 2 of them to the old teacher and eats the rest."),
        (2, "the runner covered 5km before 10am and finished 3rd while the prize of $6k went to charity"),
        (3, "The box holds 4 pens for each pupil. The shelf holds 9 books which nobody ever wanted to read at home"),
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Peter has 7 red apples in his bag. Peter gives 3 of them to the old teacher and eats the rest."),
        (11, "Here Peter has 7 red apples in his bag. Peter gives 3 of them to the old teacher and eats the rest."),
        (12, "Peter has 7 red apples in his bag. Mary gives 3 of them to the old teacher and eats the rest."),
        (13, "the runner covered 8mi before 11pm and finished 4th while the prize of $9k went to charity"),
        (14, "A box holds 6 pens for each pupil. The shelf holds 8 books which nobody ever wanted to read at home"),
    ], "doc_id long, text string")
    for small in (4_000_000, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, items, small=small).collect()}
        assert got == {(10, 1): "changed", (11, 1): "changed", (13, 2): "changed", (14, 3): "changed"}


def test_templates_verbatim_windows_of_an_inconsistent_run(spark):
    long = "in 1990 the small town by the river built a bridge of stone and steel and opened a school for all of the children who lived on either side of the water until the flood came again in {} and took it"
    items = spark.createDataFrame([(1, long.format(1990)), (2, "each 1990 copy of a 1990 book and each 1990 print")], "item_id long, text string")
    docs = spark.createDataFrame([(10, long.format(1991)), (11, "each 1990 copy of a 1991 book and each 1992 print")], "doc_id long, text string")
    for small in (4_000_000, 0):
        got = [(r.doc_id, r.item_id, r.item_windows - r.n_windows, r.kind) for r in templates.leaks(docs, items, small=small).collect()]
        assert got == [(10, 1, 4, "verbatim")]


def test_templates_items_of_placeholders_or_few_words(spark):
    items = spark.createDataFrame([(1, "Compute 12 + 7 * 3 - 4"), (2, "Name Zanzibar's capital"), (3, "Xylem?"), (4, "sold 3 kg 4 kg 5 kg 6 kg on 7 days and then went home")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Q. compute 12 + 7 * 3 - 4 now"), (11, "Compute 12 + 8 * 3 - 4"), (12, "Please name Zanzibar's capital."), (13, "name the capital"), (14, "the xylem"), (15, "xylems"),
        (16, "sold 3 kg 4 kg 5 kg 6 kg on 7 days and then went home"), (17, "sold 13 kg 14 kg 15 kg 16 kg on 17 days and then went home"), (18, None), (19, ""),
    ], "doc_id long, text string")
    for small in (4_000_000, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in templates.leaks(docs, items, small=small).collect()}
        assert got == {(10, 1): "verbatim", (12, 2): "verbatim", (14, 3): "verbatim", (16, 4): "verbatim", (17, 4): "changed"}


def test_templates_null_and_shared_item_ids(spark):
    a, b = "the quick stone rolled under seven green hills beside a very old river", "a grey heron stood near that low bridge and looked for frogs in the reeds all through the long wet morning"
    items = spark.createDataFrame([(None, a), (5, a), (5, b), (5, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, b), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.n_windows, r.item_windows) for r in templates.leaks(docs, items).collect())
    assert got == [(0, 0, 9, 9), (0, 5, 9, 9), (1, 0, 9, 9), (1, 5, 9, 9), (2, 5, 17, 17)]
    assert stages.drop_leaked(docs, items.where("item_id is null")).count() == 1


def test_media(docs, none, odd, rows):
    got = {r.doc_id: r for r in jpeg.media_report(jpeg.with_media(docs)).collect()}
    for n, t in rows:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[n]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    assert got[6].media_sha256 == got[7].media_sha256 and got[6].feature == got[7].feature
    assert jpeg.media_report(jpeg.with_media(none)).count() == 0 and jpeg.media_report(jpeg.with_media(odd)).count() == 5


def test_jpeg_all_bytes():
    rng = np.random.default_rng(0)
    made = [rng.integers(0, 256, n * 64).astype(np.uint8) for n in (1, 2, 15, 16, 17, 129, 700)] + [np.full(64 * 9, 255, np.uint8), np.zeros(64, np.uint8)]
    files = jpeg.encode(made)
    for p, (picture, blocks) in zip(made, jpeg.decode(files), strict=True):
        assert jpeg.payload_of(picture, blocks) == p.tobytes()
        assert jpeg.thumbnail(picture, blocks).shape == (picture.height // 8, picture.width // 8)
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


def slow_jpeg(data):
    """A plain baseline decoder, a bit at a time: markers' sizes and the coefficients of all blocks in scan order."""
    at, tables, parts, interval = 2, {}, [], 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                codes, code, k = {}, 0, 17
                for length in range(1, 17):
                    for _ in range(body[length]):
                        codes[f"{code:0{length}b}"] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]], body = codes, body[k:]
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(body[5])]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            use = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(body[0])}
            break
    pieces, now = [], bytearray()
    while data[at : at + 2] != b"\xff\xd9":
        if data[at] == 255 and 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(bytes(now))
            now, at = bytearray(), at + 2
        else:
            now.append(data[at])
            at += 2 if data[at] == 255 else 1
    pieces.append(bytes(now))
    many = len(parts) > 1
    h, v = (max(p[1] for p in parts), max(p[2] for p in parts)) if many else (1, 1)
    units = -(-width // (8 * h)) * -(-height // (8 * v))
    blocks = []
    for n, piece in enumerate(pieces):
        bits, place = "".join(f"{b:08b}" for b in piece), 0

        def value(size):
            nonlocal place
            raw, place = bits[place : place + size], place + size
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

        def symbol(table):
            nonlocal place
            word = ""
            while word not in table:
                word, place = word + bits[place], place + 1
            return table[word]

        last = dict.fromkeys(use, 0)
        for _ in range(min(interval or units, units - n * (interval or units))):
            for part, across, down in parts:
                for _ in range(across * down if many else 1):
                    block, k = [0] * 64, 1
                    last[part] += value(symbol(tables[use[part][0]]))
                    block[0] = last[part]
                    while k < 64:
                        s = symbol(tables[use[part][1]])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = value(s & 15)
                        k += 1
                    blocks.append(block)
    return width, height, blocks


def foreign_jpeg(rng, width, height, factors, interval):
    """A file of several components with tables of its own; and its coefficients."""
    codes = {s: f"{k:08b}" for k, s in enumerate([0, 0xF0, *(r << 4 | z for r in range(16) for z in range(1, 9))])}
    dc = {z: f"{z:04b}" for z in range(12)}
    segment = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    many = len(factors) > 1
    h, v = (max(f[0] for f in factors), max(f[1] for f in factors)) if many else (1, 1)
    units = -(-width // (8 * h)) * -(-height // (8 * v))
    said = lambda x: (abs(x).bit_length(), f"{x if x > 0 else x + (1 << abs(x).bit_length()) - 1:0{abs(x).bit_length()}b}" if x else "")
    blocks, scan, bits, last = [], b"", "", [0] * len(factors)

    def closed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for u in range(units):
        if interval and u and u % interval == 0:
            scan, bits, last = scan + closed(bits) + bytes([255, 0xD0 + (u // interval - 1) % 8]), "", [0] * len(factors)
        for c, (across, down) in enumerate(factors):
            for _ in range(across * down if many else 1):
                block = [rng.randint(-200, 200), *(rng.choice([0, 0, 0, 0, 0, rng.randint(-90, 90)]) for _ in range(63))]
                if rng.random() < 0.3:
                    block[rng.randint(2, 30) :] = [0] * (64 - len(block[: rng.randint(2, 30)]))
                    block = (block + [0] * 64)[:64]
                z, raw = said(block[0] - last[c])
                bits, last[c], run = bits + dc[z] + raw, block[0], 0
                for x in block[1:]:
                    if x == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + codes[0xF0], run - 16
                    z, raw = said(x)
                    bits, run = bits + codes[run << 4 | z] + raw, 0
                bits += codes[0] if run else ""
                blocks.append(block)
    tables = segment(0xC4, b"\x01" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, b"\x13" + bytes([0] * 7 + [len(codes)] + [0] * 8) + bytes(codes))
    frame = segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([7 + c, a << 4 | b, 0]) for c, (a, b) in enumerate(factors)))
    scan_head = segment(0xDA, bytes([len(factors)]) + b"".join(bytes([7 + c, 0x13]) for c in range(len(factors))) + bytes([0, 63, 0]))
    restart = segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    return b"\xff\xd8" + segment(0xDB, bytes([0] + [3] * 64)) + tables + frame + restart + scan_head + scan + closed(bits) + b"\xff\xd9", blocks


def test_jpeg_foreign_files():
    rng = random.Random(12)
    made = [foreign_jpeg(rng, *shape) for shape in ((50, 41, [(2, 2), (1, 1), (1, 1)], 3), (33, 20, [(2, 1), (1, 1), (1, 1)], 0), (70, 30, [(1, 1)], 5), (16, 16, [(1, 1), (1, 1), (1, 1)], 1))]
    for (file, blocks), (picture, got) in zip(made, jpeg.decode([f for f, _ in made]), strict=True):
        assert got.tolist() == blocks == slow_jpeg(file)[2]
        pixels = jpeg.thumbnail(picture, got)
        assert pixels.shape == (-(-picture.height // 8), -(-picture.width // 8))
        if len(picture.parts) == 1:
            assert pixels.ravel().tolist() == [min(255, max(0, round(b[0] * 3 / 8) + 128)) for b in blocks]


def test_jpeg_equals_a_plain_decoder(monkeypatch):
    """Our files by a decoder that shares no code; whole or in pieces; and the thumbnail's hash cell by cell."""
    rng = np.random.default_rng(2)
    made = [rng.choice(np.frombuffer("the of and é,. \n".encode(), np.uint8), 64 * n) for n in (1, 9, 40, 130)]
    files = jpeg.encode(made)
    monkeypatch.setattr(jpeg, "_PIECE", 64)
    assert jpeg.encode(made) == files
    for p, f, (picture, blocks) in zip(made, files, jpeg.decode(files), strict=True):
        width, height, slow = slow_jpeg(f)
        assert (width, height) == (picture.width, picture.height) and blocks.tolist() == slow
        back = {v: b for b, v in enumerate(jpeg.VALUES.tolist())}
        assert bytes(back[x] for b in slow[: len(p) // 64] for x in b) == p.tobytes()
        rows, cols = height // 8, width // 8
        pixel = [[min(255, max(0, round(slow[y * cols + x][0] / 8) + 128)) for x in range(cols)] for y in range(rows)]
        assert jpeg.thumbnail(picture, blocks).tolist() == pixel
        cells = []
        for y in range(8):
            for x in range(8):
                ys = range(min(y * rows // 8, rows - 1), max((y + 1) * rows // 8, min(y * rows // 8, rows - 1) + 1))
                xs = range(min(x * cols // 8, cols - 1), max((x + 1) * cols // 8, min(x * cols // 8, cols - 1) + 1))
                cells.append(sum(pixel[i][j] for i in ys for j in xs) / len(ys) / len(xs))
        mean = sum(map(sum, pixel)) / rows / cols
        assert jpeg.thumbnail_hash(jpeg.thumbnail(picture, blocks)) == f"{int(''.join(str(int(c > mean)) for c in cells), 2):016x}"


def test_long_texts_in_pieces(monkeypatch):
    """One long row in pieces gives what it gives whole: shingles, features, lines, template windows."""
    rng = random.Random(11)
    words = ["Tom", "has", "5km", "of", "red.", "12", "miles", "Ünder", "-", "the", "x" * 300, "hill", "3rd", "***", "two", "hours"]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ".\n\n", " \t"]) for _ in range(6000))
    column, one = pa.array([text]), pa.RecordBatch.from_arrays([pa.array([4]), pa.array([9]), pa.array([text])], names=["doc_id", "tag", "text"])
    data, ends = shared.buffer_of(column)
    wanted = np.unique(templates.windows(data, ends, 5, [2])[0][::3])
    order = ["hash", "pos", "n"]

    def all_of():
        line = pa.Table.from_batches(lines._line_rows(2)(iter([one]))).sort_by("pos").to_pydict()
        found = pa.Table.from_batches(templates._emit(5, "doc_id", wanted, [2])(iter([one]))).sort_by([(c, "ascending") for c in order]).to_pydict()
        return [x.tolist() for x in bytehash.distinct(*bytehash.shingles(data, ends, 5))], quality.tally(data).tolist(), line, found

    whole = all_of()
    assert whole[1] == np.bincount(quality.cells(data, ends)[1], minlength=len(whole[1])).tolist()
    for size in (1000, 7000):
        for module in (bytehash, quality):
            monkeypatch.setattr(module, "LONG", size)
        assert len(bytehash.pieces(data, ends)) > 3
        assert all_of() == whole


def test_memory_of_a_long_text():
    """A text of 24 MB: what each kernel needs beside the text."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from tidemark.llm import bytehash, lines, minhash, quality, templates
rng = np.random.default_rng(0)
words = np.array([f"w{n}" for n in range(5000)])
text = " ".join(words[rng.integers(0, 5000, 4_200_000)].tolist())
column = pa.array([text]); n = len(text); del text
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), column], names=["doc_id", "tag", "text"])
data, ends = np.frombuffer(column.buffers()[2], np.uint8)[:n], np.array([0, n])
top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
start = top()
{work}
print(n / 1e6, top() - start)
"""
    import subprocess
    import sys

    works = {
        "shingles": ("minhash.signatures(*bytehash.distinct(*bytehash.shingles(data, ends, 5)), 1)", 400),
        "lines": ("list(lines._line_rows(1)(iter([batch])))", 150),
        "features": ("quality.tally(data)", 300),
        "templates": ("list(templates._emit(5, 'doc_id', np.zeros(1, np.uint64), [])(iter([batch])))", 500),
    }
    for name, (work, most) in works.items():
        out = subprocess.run([sys.executable, "-c", code.replace("{work}", work)], capture_output=True, text=True, check=True).stdout.split()
        assert float(out[0]) > 23 and float(out[1]) < most, (name, out)


def test_quality_equals_plain_votes(spark):
    """Scores against a plain vote over the fitted vectors, a text at a time, in Python floats."""
    rng = random.Random(13)
    say = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    good, bad = ["river", "stone", "Hill,", "the", "of", "night."], ["BUY!!", "the***", "NOW!!", "river", "$$$"]
    made = [(n, say(good if n % 2 else bad, rng.randint(0, 60)) + (" éclair" if n % 5 == 0 else "")) for n in range(240)] + [(5, "river of stone"), (None, "BUY!! NOW!!"), (7, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(240)] + [(3, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, most=150, dims=8, k=7)
    assert len(model.votes) <= 150
    got = [(r.doc_id, r.text, r.score) for r in quality.with_scores(docs, model).collect()]
    for _, text, score in got:
        data = np.frombuffer((text or "").encode(), np.uint8)
        features = quality.cells(data, np.array([0, len(data)]))[1].tolist()
        count = {f: features.count(f) for f in features}
        parts = [{f: np.log1p(c) for f, c in count.items() if (f < 4096) == first} for first in (True, False)]
        vector = np.zeros(model.project.shape[1])
        for part in parts:
            length = sum(v * v for v in part.values()) ** 0.5
            for f, v in part.items():
                vector += v / length * model.project[f].astype(float)
        length = float((vector**2).sum()) ** 0.5
        if length < 1e-6:
            want = model.prior
        else:
            near = sorted(((float((vector / length * v).sum()), float(vote)) for v, vote in zip(model.vectors.astype(float), model.votes, strict=True)), reverse=True)[: model.k]
            weight = [min(1, max(0, s)) ** model.power for s, _ in near]
            want = (sum(w * v for w, (_, v) in zip(weight, near, strict=True)) + 1e-3 * model.prior) / (sum(weight) + 1e-3)
        assert score == pytest.approx(want, abs=2e-3), text
    assert {r.score for r in quality.with_scores(docs.where("text is null"), model).collect()} == {model.prior}


def plain_leaks(doc, item, size=5, percent=80):
    """Template leaks of texts without opening names or joined units, in plain Python: words, slots, windows, runs."""
    numbers, units = set(templates.NUMBERS.split()), set(templates.UNITS.split())

    def words_of(text):
        out, opens, before = [], True, None
        for raw in text.split():
            w = raw.strip(".,!?")
            kind = "#" if w.isdigit() or w.lower() in numbers else "@" if w[0].isupper() and not opens else "%" if before == "#" and w.lower() in units else None
            out.append((w.lower(), kind))
            opens, before = raw[-1] in ".!?", kind
        return out

    a, b = words_of(doc), words_of(item)
    shape = lambda w: tuple(kind or word for word, kind in w)
    fit = [j for j in range(len(b) - size + 1) if sum(k is not None for _, k in b[j : j + size]) <= size - 2]
    best = 0
    for shift in range(-len(b), len(a) + 1):
        at = [j for j in fit if 0 <= j + shift <= len(a) - size and shape(a[j + shift : j + shift + size]) == shape(b[j : j + size])]
        said = {}
        for j in at:
            for (x, kind), (y, _) in zip(a[j + shift : j + shift + size], b[j : j + size], strict=True):
                if kind:
                    said.setdefault(y, set()).add(x)
        steady = all(len(v) == 1 for v in said.values())
        best = max(best, len([j for j in at if steady or a[j + shift : j + shift + size] == b[j : j + size]]))
    return best * 100 >= percent * len(fit) and best > 0


def test_templates_equal_plain_python(spark):
    """Random questions and changed copies of them, each pair by brute force over all shifts."""
    rng = random.Random(17)
    plain = "a man sold some of his old green books and then walked along that river to meet another trader near this quiet bridge".split()

    def sentence(n):
        out = ["the"]
        while len(out) < n:
            out += rng.choice([[rng.choice(plain)], [rng.choice(plain)], [rng.choice(plain)], [str(rng.randint(2, 99)), rng.choice(["km", "hours", "kg"])], [rng.choice(["Anna", "Peter", "Maria"])]])
        return out

    items, docs = [], []
    for k in range(30):
        words = sentence(24)
        items.append((k, " ".join(words)))
        values, copy = {}, []
        broken = rng.random() < 0.3
        for w in words:
            if w.isdigit():
                w = str(rng.randint(100, 999)) if broken else values.setdefault(w, str(100 + len(values)))
            elif w in ("Anna", "Peter", "Maria"):
                w = values.setdefault(w, ["Otto", "Lena", "Karl"][len([v for v in values.values() if v.isalpha()]) % 3])
            elif rng.random() < rng.choice([0, 0, 0.15]):
                w = "changed"
            copy.append(w)
        docs.append((100 + k, " ".join(["some", "words", "before", "it", *copy, "and", "after"])))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1])]
    want = {(d, i) for d, t in docs if t for i, q in items if plain_leaks(t, q)}
    frame = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, tag string, item_id string")
    for small in (4_000_000, 0):
        got = [(r.doc_id, r.item_id) for r in templates.leaks(frame, spark.createDataFrame(items, "item_id long, text string"), small=small).collect()]
        assert set(got) == want and len(got) == len(want)
    assert 10 < len(want) < 60


def test_warc_repeats_and_nulls(spark):
    """Repeated rows, null ids and equal payloads without an id."""
    big = "z" * 1200
    made = [(1, "u", big), (1, "u", big), (2, "v", big), (None, "w", big), (None, "q", "y" * 1500), (None, "r", "y" * 1500), (3, None, None), (3, "other", None)]
    out = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.capture_report(spark.createDataFrame(made, "page_id long, url string, html string")).collect())
    assert out == [(False, 1, 1200, "revisit", 2), (False, 1, 1200, "revisit", 2), (False, 2, 1200, "response", 0), (False, 3, 0, "response", 0), (False, 3, 0, "response", 0), (True, 0, 1200, "revisit", 2), (True, 0, 1500, "response", 0), (True, 0, 1500, "response", 0)]


STAGES = {
    "keep_good": lambda d: stages.keep_good(d, d.sparkSession.createDataFrame([(n, 1) for n in range(20)], "doc_id long, quality int")),
    "drop_common_lines": lambda d: stages.drop_common_lines(d, 10, 1),
    "keep_one_of_each": stages.keep_one_of_each,
    "drop_leaked": lambda d: stages.drop_leaked(d, d.sparkSession.createDataFrame([(1, "the quick stone rolled under seven green hills beside a very old river")], "item_id long, text string")),
}
CLASHING = "row tag keep score dropped _whole _own_score _tag _id _rtag _rid node comp sets n_same shingles a.b".split()


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_nulls_and_repeats(spark, name):
    """Columns with a stage's own names, null texts and ids, repeats, ties, a long text, and an empty table."""
    leaked = "Here the quick stone rolled under seven green hills beside a very old river."
    made = [(None, "a b c d e f g h"), (None, None), (5, "a b c d e f g h"), (5, "i j k l m n o p"), (5, "i j k l m n o p"), (6, ""), (7, leaked), (7, leaked), (8, "word " * 200_000)]
    made += [(20 + n, f"own {n} of these {n * n} words\n a Common line") for n in range(10)]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(n, t, None if t is None else len(t), *(f"{c}{k if c == 'node' else ''}" for c in CLASHING)) for k, (n, t) in enumerate(made)], schema)
    out = STAGES[name](docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = [tuple(r)[:3] for r in out.collect()]
    assert {tuple(r)[3:][:4] for r in out.collect()} == {("row", "tag", "keep", "score")}
    want = [(n, t, None if t is None else len(t)) for n, t in made]
    if name == "drop_common_lines":
        cut = lambda t: t and t.removesuffix("\n a Common line")
        want = [(n, cut(t), None if t is None else len(cut(t))) for n, t in made]
    elif name == "keep_one_of_each":
        want = [r for k, r in enumerate(want) if k not in (0, 4, 7)]
    elif name == "drop_leaked":
        want = [r for r in want if r[0] != 7]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or 0)
    assert sorted(rows, key=key) == sorted(want, key=key)
    empty = STAGES[name](docs.limit(0))
    assert empty.count() == 0 and empty.columns == docs.columns


def test_pipeline(spark, tmp_path):
    """Each stage against plain Python; the quality scores are taken from the operator."""
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("river stone hill cloud night plain the of and".split()) + str(rng.randint(0, 9)) for _ in range(n))
    item = say(30)
    made = [(n, say(60) + ("\nshared line" if n % 2 else "")) for n in range(60)]
    made += [(60, made[3][1]), (61, made[4][1] + " more"), (62, say(20) + " " + item), (63, None), (64, "")] + [(100 + n, " ".join(w.upper() + "!!" for w in say(40).split())) for n in range(30)]
    spark.createDataFrame([(n, t, "en", "s", len(t or "")) for n, t in made], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 0 if n >= 100 else 1) for n, _ in made], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.with_scores(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    left = [(n, t or "") for n, t in made if scores[n] >= 0.3]
    assert {n for n, _ in left} >= {n for n, _ in made if n < 63} and not any(n >= 100 for n, _ in left)
    count = {}
    for n, t in left:
        for k in {line_key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    left = [(n, "\n".join(x for x in t.split("\n") if not line_key(x) or count[line_key(x)] < 10)) for n, t in left]
    _, comp = components(left, 5)
    left = [(n, t) for n, t in left if comp[n] == n and item not in t]
    assert got == {n: sha(t) for n, t in left}
