"""The operators against brute force on a fixture with nulls, empty and long texts, copies, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import chat, decontamination, language, neardup, packing, quality, rules, substrings, tokencount, warc
from statloom.llm.components import components

SPACES = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, span int"


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(200), text(60)
    texts = [base, base, base.replace(" ", "\n"), text(150), None, "", " \t\n", "one", "A b C", "the cat", text(80) + " " + passage + " " + text(70), passage, text(20) + " " + passage, "x " * 90, "!!! ??? ...", "日本語 " * 60, text(3000)]
    for i in range(6):
        own = base.split(" ")
        own[10 * i] = f"new{i}"
        texts.append(" ".join(own))
    return [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "clash", "clash", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates_equal_brute_force(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert neardup.drop_near_duplicates(docs).columns == docs.columns


def test_blocks_find_links_that_no_hub_has(spark, rows, docs):
    packed = substrings.compressed(docs.select("doc_id", "text"), "text", "text")
    signed = neardup.signatures(docs.select("doc_id", "text"))
    bits = signed.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "bits")
    members = bits.select("id", F.lit(1).cast("long").alias("bucket"), F.col("id").alias("component"))
    links = {(r["a"], r["b"]) for r in neardup._block_links(members, bits, packed, 0.55, 5, 75).collect()}
    assert {(1, 0), (2, 0), (17, 0), (18, 17)} <= links


def test_components_of_a_long_path(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(path).collect()} == {0}


def test_substrings_equal_brute_force(docs, rows):
    count = Counter(tuple(w[i : i + 35]) for _, t, *_ in rows for w in [words_of(t)] for i in range(len(w) - 34))
    want = {}
    for k, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_digest(docs).collect()}
    assert got == want
    same = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert same[3] == dict((r[0], r[1]) for r in rows)[3] and same[4] is None


def removed_by_windows(rows, window):
    """n_removed of each (doc_id, text), by counting all windows."""
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - window + 1))
    out = []
    for k, t in rows:
        w, gone = words_of(t), set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((k, len(gone)))
    return sorted(out)


def test_automata_alone_say_what_goes(spark):
    """Near copies share most windows of a passage; small blocks split its phrases and pieces. Without phrases nothing is found."""
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(120)]
    rows = []
    for i in range(40):
        own = list(base)
        for j in rng.sample(range(120), i % 4):
            own[j] = f"new{i}"
        rows.append((i, " ".join([f"head{i}", *own[rng.randint(0, 60) :], f"tail{i}"])))
    rows += [(100, "x " * 50), (101, "y z " * 9), (102, " ".join(base[:11])), (102, " ".join(base[50:64]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"most_phrases": 2, "most_pieces": 3}):
        got = sorted((r["doc_id"], r["n_removed"]) for r in substrings.repeat_digest(df, window=12, gram=4, **options).collect())
        assert got == removed_by_windows(rows, 12)
    keyed = df.select(*substrings.row_key(F.col("doc_id"), F.col("text")), "text")
    pieces, phrases = substrings._pieces_and_phrases(keyed, 12, 4)
    found = substrings.occurrences(pieces, phrases, 12).count()
    assert found > substrings.occurrences(pieces, phrases.where("pmod(xxhash64(words), 2) = 0"), 12).count() > 0
    assert substrings.occurrences(pieces, phrases.limit(0), 12).count() == 0


def test_long_texts_cross_chunks_and_blocks(spark):
    """Texts beyond the sizes at which the helpers cut: a megabyte of words, and one word of a megabyte."""
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, "z" * 1_200_000), (3, "z" * 1_200_000 + " " + " ".join(long[70_000:70_080])), (4, " ".join(long[149_000:] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.repeat_digest(df).collect()}
    assert got == {1: (150_000, 1080), 2: (1, 0), 3: (81, 80), 4: (1001, 1000)}
    found = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination_digest(df, spark.createDataFrame([(1, " ".join(long[70_000:70_040]))], "item_id long, text string")).collect()}
    assert found == {1: (150_000, 40), 2: (1, 0), 3: (81, 40), 4: (1001, 0)}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert near == {1: (149_996, 1), 2: (1, 2), 3: (77, 3), 4: (997, 4)}
    packed = packing.pack_documents(df.where("doc_id <> 1"), capacity=64)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_substrings_of_repeated_rows_and_other_windows(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text), (1, text), (2, "z " + text + " q"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.repeat_digest(df, window=5, gram=2).collect())
    assert got == [(0, 0), (1, 10), (1, 10), (2, 10)]


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination_equals_brute_force(spark, docs, rows, most):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, rows[3][1][:200]), (2, "The Cat"), (10, rows[11][1]), (3, None), (4, ""), (5, "cat!"), (None, "one")]
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if k and i is not None else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    want = {}
    for d, t, *_ in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination_digest(docs, benchmark, max_broadcast_windows=most).collect()}
    assert got == want
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_packing_keeps_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    from statloom.llm.units import tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = defaultdict(list)
    for r in packing.pack_documents(docs, keep_ids=True).collect():
        got[r["doc_id"]].append(r)
    used = defaultdict(list)
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(got[d], key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == ids and {r["doc_tokens"] for r in pieces} == {len(ids)}
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_first_fit_decreasing_equals_the_plain_scan():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 101, 300).tolist(), reverse=True))
    room, want = [], []
    for size in lengths.tolist():
        i = next((j for j, r in enumerate(room) if r >= size), len(room))
        room[i:] = room[i:] or [100]
        want.append((i, 100 - room[i]))
        room[i] -= size
    where, offset = packing.first_fit_decreasing(lengths, 100)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == want


def test_word_units_equal_whole_texts(spark):
    from tokenizers import Tokenizer

    from statloom.llm.units import tokenizer_file

    texts = ["it's O'Neil's 'stupid !'s 12ab3 a1-b2 <|endoftext|> <|X ÉCOLE école E\u0301 x", "İstanbul ΣΑΣ naïve\u00a0x ½ \x00 \x7f ª", "don't''ve 're-do"]
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.cut_pieces(df, keep_ids=True).collect():
        assert r["ids"][:-1] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_quality_rules_equal_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for d, t, *_ in rows:
        w, r = words_of(t), got[d]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert got[3]["kept"] and not got[4]["kept"]
    assert rules.filter_quality(docs).columns == docs.columns


def test_token_counts_equal_a_plain_search(spark, docs, rows):
    """A search over all segmentations, in order of their ends, with scores from counts of our own."""
    import math
    from functools import lru_cache

    from sentencepiece import SentencePieceProcessor

    from statloom.llm.units import tokenizer_file

    model = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    used = Counter(i for _, t, *_ in rows for w in words_of(t) for i in model.encode(w))
    counts, size = tokencount.piece_counts(docs, "piece_bpe_32k.model")
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == used and size == model.get_piece_size()
    total = sum(used.values()) + size
    score = {model.id_to_piece(i): math.log((used[i] + 1) / total) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    @lru_cache(maxsize=None)
    def best(word):
        if not word:
            return 0.0, 0
        found = None
        for k in range(len(word)):  # the longest last piece first
            if word[k:] in score:
                s, n = best(word[:k])
                if found is None or s + score[word[k:]] > found[0] + 1e-12:
                    found = s + score[word[k:]], n + 1
        if word[-1] not in score:
            s, n = best(word[:-1])
            size = len(word[-1].encode())
            if found is None or s - size * math.log(total) > found[0]:
                found = s - size * math.log(total), n + size
        return found

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.count_tokens(docs).collect()}
    for d, t, *_ in rows:
        assert got[d] == (len(words_of(t)), sum(best("▁" + w)[1] for w in words_of(t)))
    trie = tokencount.CountingTrie(score, -math.log(total))
    for word in ("▁" + "abé日" * 80, "▁🙂x", "▁"):  # the first is beyond what the trie keeps
        short = word[:150]
        assert trie.count(short) == best(short)[1]
        sys_limit = trie.count(word)
        assert sys_limit == _by_ends(word, score, total)


def _by_ends(word, score, total):
    import math

    found = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(found[k][0] + score[word[k:end]], -k, found[k][1] + 1) for k in range(end) if word[k:end] in score]
        if word[end - 1] not in score:
            size = len(word[end - 1].encode())
            options.append((found[end - 1][0] - size * math.log(total), -end, found[end - 1][1] + size))
        s, _, n = max(options)
        found.append((s, n))
    return found[-1][1]


def test_language_and_quality_on_a_small_corpus(spark):
    en, de = "the of and that with was for this then", "der die und nicht ein auf für schön über"
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice((en if i % 2 else de).split()) for _ in range(60)) + (" $$$ %%%" * 30 if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(300)]
    rows += [(900, None, "en"), (901, "123 !!", None), (902, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:300])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)] + [(7, None)], "doc_id long, quality int")
    scored = {r["doc_id"]: r for r in quality.classify_quality(df, labels).collect()}
    assert sum(scored[i]["predicted"] == int(i % 5 != 0) for i in range(300)) > 290 and all(0 <= r["score"] <= 1 for r in scored.values())
    none = quality.classify_quality(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_archives_round_trip(spark, tmp_path):
    same = "<p>é</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://b.org/x", same), (2, "http://a.org/y", same), (3, None, None), (4, "https://u@A.org:8/z#t", ""), (5, "http://a.org/\r\ny", "q"), (None, "u", "q"), (None, "v", "r"), (None, "w", "r"), (1 << 60, "http://a.org/y", "z"), (-(1 << 62), "", same), (7, "http://a.org/y", "s"), (7, "http://a.org/y", "s"), (6, "t", "s"), (9, "big", "0123456789" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"archive": F.lit(1), "size": F.lit("x"), "target": F.lit(None).cast("string")})
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.asDict() for r in warc.capture_histories(pages.repartition(3), path=path, archive_bytes=150, fan_in=2, range_rows=3).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    most = {}
    for i, _, html in rows:
        most[html or ""] = max(most.get(html or "", -(1 << 63)), -(1 << 63) if i is None else i)
    digest = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    want = []
    for i, _, html in rows:
        raw, target = (html or "").encode(), most[html or ""]
        other = target > -(1 << 63) and target != i
        want.append((i, len(raw), digest(raw), "revisit" if other else "response", target if other else None))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys) and next(r for r in got if r["page_id"] == 1)["captured"] == "2024-01-01T00:00:01Z"
    for r in got:  # each record can be read alone at its place
        head, block = warc.read_record(path, r["archive"], r["record_offset"])
        assert head["WARC-Type"] == r["record_type"] and (r["record_type"] == "revisit" or digest(block) == r["payload_digest"])
    assert len({r["archive"] for r in got}) > 4
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(2)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(((int(x), i, j), None) for j, x in enumerate(rng.integers(0, 50, rng.integers(0, 20)))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_chat_round_trip_and_typed_parts(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\<|end|>\n<|role|>x\n\\"), (2, 0, None, None), (2, 1, "assistant", None), (3, 5, "assistant", "😀<"), (3, 5, "assistant", "é"), (None, 1, "a\nb\\n", "t"), (None, 2, "<|body|>\n", "<|end|>"), (4, 1, "assistant", "x" * 100_000), (4, None, "assistant", "<|"), (4, 1, "assistant", "x" * 100_000)]
    rows += [(5, i, "assistant", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ts": F.lit(1), "at": F.lit("x"), "k": F.lit(2), "body": F.lit("y")})
    got = {r["conv_id"]: r for r in chat.conversation_digest(df).collect()}
    assert len(got) == 6
    for conv in got:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = [("text", "see", None, None), ("image", None, "i1", 2), ("audio", None, "a1", 3), ("text", "<|image|>", None, None), ("end", None, "e", None), ("text", "\n<", None, None), ("text", "|end|>\n", None, None)]
    typed = spark.createDataFrame([(1, 0, "user", parts), (2, 0, "user", None), (2, 1, None, [])], f"conv_id long, turn long, role string, content {chat.PARTS}")
    r, empty = chat.format_conversations(typed).orderBy("conv_id").collect()
    assert r["formatted"] == "<|role|>user<|body|>\nsee<|part:image|><|part:audio|><\\|image|><|part:end|>\n<\\|end|>\n<|end|>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i1", 512), ("audio", "a1", 75), ("end", "e", 1)]
    assert empty["n_turns"] == 2 and empty["attachments"] == []
    back = chat.format_conversations(typed).select("conv_id", chat.read_back(chat.turn_strings(F.col("formatted"))).alias("t")).orderBy("conv_id").first()["t"]
    assert [(t["role"], t["text"]) for t in back] == [("user", "see<|part:image|><|part:audio|><|image|><|part:end|>\n<|end|>\n")]


def test_calibration_never_falls():
    at, value = quality.isotonic(np.array([0.1, 0.5, 0.9]), np.array([0.0, 10.0, 60.0]), np.array([1.0, 100.0, 100.0]))
    assert (np.diff(value) >= 0).all() and np.allclose(value, [0.0, 0.1, 0.6], atol=0.01)
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = rng.integers(1, 12)
        weight = rng.integers(1, 30, n).astype(float)
        total = np.floor(rng.random(n) * (weight + 1))
        at, value = quality.isotonic(np.arange(n).astype(float), total, weight)
        assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all() and (value > 0).all() and (value < 1).all()
        # the plain definition: the largest over starts of the smallest mean to any end
        t, w = total + weight / (2 * weight.sum()), weight * (1 + 1 / weight.sum())
        plain = [max(min(t[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose([min(value, key=lambda v: abs(v - p)) for p in plain], plain)


def test_normal_equations_equal_a_plain_solution(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0).astype(float)
    held = rng.random(400) < 0.2
    df = spark.createDataFrame([(a.tolist(), float(b), bool(c)) for a, b, c in zip(x, y, held, strict=True)], "x array<double>, y double, calibrate boolean").repartition(5)
    model = quality.train(df)
    z = quality.fourier(x[~held], x.mean(0), x.std(0))
    d = z.shape[1]
    penalty = quality.RIDGE * (~held).sum() * np.eye(d) + 1e-9 * np.eye(d)
    penalty[0, 0] = 1e-9
    assert np.allclose(model["weights"], np.linalg.solve(z.T @ z + penalty, z.T @ y[~held]), atol=1e-6)
    score = quality.predict(x, model)
    raw = quality.fourier(x, model["mean"], model["scale"]) @ model["weights"]
    assert (np.diff(score[np.argsort(raw)]) >= 0).all() and ((score >= 0.5) == (y == 1))[held].mean() > 0.65


def test_mixtures_of_many_languages(spark):
    """Six invented languages, and documents that mix five of them: no limit on the set, and the shares come out."""
    rng = random.Random(2)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    vocabulary = [["".join(rng.choice(s) for _ in range(rng.randint(3, 7))) for _ in range(40)] for s in letters]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 6]) for _ in range(50)), f"l{i % 6}") for i in range(240)]
    rows += [(1000, " ".join(rng.choice(vocabulary[j]) for j in range(5) for _ in range(60)), None), (1001, "word! " * 3, None), (None, "abcd", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "held_out": F.lit(1), "languages": F.lit(2)})
    got = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.9 for i, _, lang in rows[:240])
    assert sorted(got[1000]["languages"]) == ["l0", "l1", "l2", "l3", "l4"] and all(abs(p - 0.2) < 0.05 for p in got[1000]["proportions"])


def test_fertility_verdict_equals_brute_force(spark):
    """Characters a token, bytes and entropy by coding each word alone, for texts on both sides of the bands."""
    import math
    import unicodedata

    from sentencepiece import SentencePieceProcessor

    from statloom.llm.units import tokenizer_file

    rng = random.Random(7)
    words = lambda s, n, size: " ".join("".join(rng.choice(s) for _ in range(size)) for _ in range(n))
    texts = [
        "the quick brown fox jumps over a lazy dog while seven wizards make toxic brew for the evil queen and jack " * 1 + words("abcdefghijklmnopqrstuvwxyz", 60, 5),
        " ".join(f"common word number {i} of many in this plain text that goes on" for i in range(12)), words("!?;:", 80, 6) + " a b c", words("日本語文字列漢", 60, 4), words("абвгдежзик", 60, 5), words("αβγδεζηθ", 60, 5),
        words("؀؁𐎀𐎁", 60, 3) + " alpha", words("😀😁😂", 70, 2), words("ab", 60, 1), "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz " * 60, words("אבגדה", 55, 4), words("कखगघ", 60, 3),
    ]
    model = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"kept": F.lit(1), "script": F.lit("x")})
    names = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "HEBREW": "semitic", "ARABIC": "semitic", "DEVANAGARI": "indic", "CJK": "cjk"}
    verdicts = []
    for r in rules.quality_rules(df).orderBy("doc_id").collect():
        own = texts[r["doc_id"]].split(" ")
        ids = [i for w in own if w for i in model.encode(w)]
        share = [n / len(ids) for n in Counter(ids).values()]
        chars, byte, entropy = sum(map(len, own)) / len(ids), sum(map(model.is_byte, ids)) / len(ids), -sum(p * math.log2(p) for p in share)
        assert (r["n_tokens"], pytest.approx(r["chars_per_token"]), pytest.approx(r["byte_share"]), pytest.approx(r["token_entropy"], abs=1e-9)) == (len(ids), chars, byte, entropy)
        spoken = Counter(names.get(unicodedata.name(c, "?").split(" ")[0], "other") for c in texts[r["doc_id"]] if not c.isascii() or c.isalpha())
        script = max(rules.SCRIPTS, key=lambda s: spoken[s]) if spoken else "other"
        if not any(x in texts[r["doc_id"]] for x in "؀😀"):  # the lead byte says more than the name there
            assert r["script"] == script
        low, high, most, least = rules.BANDS[r["script"]]
        assert r["kept"] == (not r["base_failed"] and low <= chars <= high and byte <= most and entropy >= least)
        verdicts.append((r["base_failed"], r["kept"]))
    assert (False, False) in verdicts and (False, True) in verdicts and (True, False) in verdicts


def test_equal_rows_without_id_meet_in_many_groups(spark):
    df = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"))
    packed = packing.pack_documents(df)
    assert packed.count() == 9000 and packed.select(F.shiftright("sequence_id", 32).alias("g")).groupBy("g").count().agg(F.max("count")).first()[0] < 2500


def test_empty_tables_give_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for out in (neardup.near_duplicates(empty), substrings.repeat_digest(empty), packing.pack_documents(empty), rules.quality_rules(empty), decontamination.contamination_digest(empty, benchmark), language.identify_languages(empty), quality.classify_quality(empty, labels), tokencount.count_tokens(empty), chat.conversation_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert out.count() == 0
