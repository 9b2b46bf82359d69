"""Operators of the llm subpackage against brute force and on edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetloom.llm import encode, history, leaks, runs, truncation
from tests_shared import metres

# --- runs ------------------------------------------------------------------

PINGS = "device_serial string, event_timestamp timestamp_ntz, latitude double, longitude double, ingested_at timestamp_ntz, row_id string, n string, salt string"
T0 = datetime(2025, 1, 25, 20)


def pings(spark, rows):
    stamp = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return spark.createDataFrame([(d, stamp(s), la, lo, T0 + timedelta(days=k), f"r{i:06d}", "x", "x") for i, (d, s, la, lo, k) in enumerate(rows)], PINGS)


def slow_runs(points):
    out, i = [], 0
    while i < len(points):
        j = i + 1
        while j < len(points) and points[j][0] - points[j - 1][0] <= 21_600 and metres(points[i][1:], points[j][1:]) <= 60:
            j += 1
        if j - i >= 3:
            out.append((points[i][0], points[j - 1][0], j - i))
            i = j
        else:
            i += 1
    return out


def test_near_runs_against_brute_force(spark):
    rng, rows, expected = random.Random(7), [], set()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    for d in range(20):
        t, lat, points = 0, float(d), []
        for _ in range(150):
            t += rng.choice([30, 600, 4000, 21_600, 21_601])
            lat += rng.choice([0, 0, 0, 0.0002, -0.0002, 0.0004, 0.0009, 0.01])
            points.append((t, lat, 5.0))
        expected |= {(f"d{d}", base + a, base + b, n) for a, b, n in slow_runs(points)}
        rows += [(f"d{d}", *p, 0) for p in points] + [(f"d{d}", s, la + 0.5, lo, 1) for s, la, lo in points[::5]] + [(f"d{d}", s + 1, 0.0, 0.0, 0) for s, _, _ in points[::4]]
    rng.shuffle(rows)
    rows += [(None, 1, 1.0, 1.0, 0), ("x", None, 1.0, 1.0, 0), ("y", 1, None, 1.0, 0), ("z", 1, 1.0, 1.0, 0)]
    got = [tuple(r) for r in runs.near_runs(pings(spark, rows)).collect()]
    assert set(got) == expected and len(got) == len(expected) > 100
    assert runs.near_runs(pings(spark, [])).count() == 0


def test_exact_runs_over_buckets(spark):
    rng = random.Random(2)
    seq = [(f"k{k}", i // 10, i * 2, rng.choice([None, 1, 1, 2])) for k in range(5) for i in range(100)]
    expected = set()
    for k in range(5):
        own = [s for s in seq if s[0] == f"k{k}"]
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and own[j + 1][3] == own[i][3]:
                j += 1
            expected.add((f"k{k}", own[i][3], own[i][2], own[j][2], j - i + 1, own[j][2] - own[i][2]))
            i = j + 1
    df = spark.createDataFrame(seq, "k string, bucket bigint, at bigint, v int").repartition(7)
    assert {tuple(r) for r in runs.collapse_runs(df, ["k"], "at", ["v"], "bucket").collect()} == expected
    assert runs.collapse_runs(df.limit(0), ["k"], "at", ["v"], "bucket").count() == 0


# --- history ---------------------------------------------------------------

COLUMNS = ["batch_id", "row_id", "ingested_at", "TM_STAMP", "DATA_SERVIDOR", "MESS_TYPE", "S/N ou IMEI", "SER_COUNT", *history.READINGS, "device", "ord"]


def log_rows(spark, rows):
    schema = ", ".join(f"`{c}` {'timestamp' if c == 'ingested_at' else 'string'}" for c in COLUMNS)
    out = []
    for batch, row, more in rows:
        r = {
            "batch_id": f"b{batch}", "row_id": row, "ingested_at": datetime(2025, 3, 1) + timedelta(days=batch), "TM_STAMP": "2025-03-01 10:00:00", "MESS_TYPE": "T2", "S/N ou IMEI": "M7", "SER_COUNT": "10",
            "LAT": "-7.46197", "LONT": "-50.1", "SPEED": "42", "HDOP": "1.2", "device": "clash", "ord": "clash",
        } | more
        out.append(tuple(r.get(c) for c in COLUMNS))
    return spark.createDataFrame(out, schema)


ROWS = [
    (0, "a", {}), (0, "a0", {}), (1, "a", {}), (1, "b", {"LAT": "-7.4620", "S/N ou IMEI": " 7 ", "SPEED": "42.0", "HDOP": "", "SER_COUNT": "0010", "LOC_STATUS": "x"}),
    (1, "c", {"LAT": "-7.4640"}), (1, "d", {"SER_COUNT": "11"}), (1, "e", {"SER_COUNT": "n/a", "TM_STAMP": "01/03/2025 10:00:00", "MESS_TYPE": " T2"}), (1, "f", {"MESS_TYPE": "T3"}),
    (1, "g", {"SPEED": "43"}), (2, "h", {"S/N ou IMEI": None}), (2, "i", {"TM_STAMP": "junk"}), (2, "j", {"MESS_TYPE": "X"}), (3, "h", {"S/N ou IMEI": None}), (3, "i", {"TM_STAMP": "junk"}),
    (3, "k", {"MESS_TYPE": "X"}), (3, "l", {"LAT": "-7,46197"}), (3, None, {"TM_STAMP": "2025-03-01 11:00:00"}), (4, None, {"TM_STAMP": "2025-03-02 11:00:00"}), (4, "m", {"SER_COUNT": "11", "LAT": None}),
    (4, "n", {"LAT": "-7.4640", "SER_COUNT": None, "SPEED": "43"}),
]
FOUND = {("b1", "a"), ("b1", "b"), ("b1", "e"), ("b3", "h"), ("b3", "i"), ("b3", "l"), ("b4", "m")}


@pytest.fixture
def clocks(spark):
    return spark.createDataFrame([("7", "UTC")], "device_serial string, zone_name string")


def test_copies_of_earlier_batches(spark, clocks):
    got = [tuple(r) for r in history.copies_of_earlier(log_rows(spark, ROWS), clocks).collect()]
    assert set(got) == FOUND and len(got) == len(FOUND)
    assert history.copies_of_earlier(log_rows(spark, []), clocks).count() == 0


def test_rows_without_batch_or_time(spark, clocks):
    rows = [(0, "a", {}), (1, "a", {"ingested_at": None}), (2, "a", {"batch_id": None}), (3, "b", {"ingested_at": None}), (3, "a", {})]
    assert {tuple(r) for r in history.copies_of_earlier(log_rows(spark, rows), clocks).collect()} == {("b3", "a"), ("b3", "b")}


def test_batch_by_batch_equals_all_at_once(spark, clocks, tmp_path):
    store = history.History(spark, str(tmp_path), ranges=4, compact_after=2)
    found = set()
    for b in range(5):
        batch = log_rows(spark, [r for r in ROWS if r[0] == b])
        found |= {tuple(r) for r in store.add(batch, clocks).collect()}
        store.compact()
    assert found == FOUND and max(store.runs().values()) <= 2 and store.table.read().count() == len(ROWS)


def offered(spark, loads):
    """Logs of files with derived row ids; a load is [(file, first row, rows, first minute)]."""
    import hashlib

    out = []
    for b, files in enumerate(loads):
        for file, first, n, minute in files:
            code = hashlib.sha256(file.encode()).hexdigest()
            for k in range(first, first + n):
                at = datetime(2025, 3, 1) + timedelta(minutes=minute + k)
                r = {"batch_id": f"b{b}", "row_id": hashlib.sha256(f"{code}:{k}".encode()).hexdigest(), "ingested_at": datetime(2025, 3, 1) + timedelta(days=b), "TM_STAMP": f"{at}", "MESS_TYPE": "T2",
                     "S/N ou IMEI": "M7", "SER_COUNT": f"{k}", "LAT": f"-7.{k:05d}", "source_file_hash": code, "source_row_number": k}
                out.append(tuple(r.get(c) for c in [*COLUMNS, "source_file_hash", "source_row_number"]))
    schema = ", ".join(f"`{c}` {'timestamp' if c == 'ingested_at' else 'string'}" for c in COLUMNS)
    return spark.createDataFrame(out, f"{schema}, source_file_hash string, source_row_number bigint")


def test_a_step_opens_only_what_it_touches(spark, tmp_path):
    clocks = spark.createDataFrame([("7", "UTC")], "device_serial string, zone_name string")
    day = 1440
    loads = [[(f"f{b}", 0, 20, b * day), (f"g{b}", 0, 5, b * day + 100)] for b in range(6)]
    loads[3].append(("f1", 3, 4, day))  # rows of an older file once more
    loads[5].append(("copy", 0, 6, 4 * day))  # the messages of f4 in another file
    logs, store = offered(spark, loads), history.History(spark, str(tmp_path), ranges=16)
    got = {tuple(r) for r in store.add_in_order(logs, clocks, at_once=1).collect()}
    assert got == {tuple(r) for r in history.copies_of_earlier(logs, clocks).collect()} and len(got) == 10
    keys = [r.get(store.table.path, 0) for r in store.reads]
    ids = [r.get(store.ids.path, 0) for r in store.reads]
    assert keys == [0, 0, 0, 1, 0, 1] and max(ids) <= 2 and sum(ids[:3]) == 0  # flat, however long the past
    store.forget()
    assert not store.table.exists()


def test_a_lost_file_hash_and_a_retry(spark, clocks, tmp_path):
    from pyspark.sql import functions as F

    logs = offered(spark, [[("f", 0, 6, 0)], [("f", 2, 2, 9000), ("n", 0, 2, 100)], [("f", 0, 1, 5000)]])
    lost = logs.withColumn("source_file_hash", F.when(F.col("batch_id") != "b1", F.col("source_file_hash")))
    expected = {tuple(r) for r in history.copies_of_earlier(lost, clocks).collect()}
    assert len(expected) == 3
    store = history.History(spark, str(tmp_path), ranges=4)
    first = lost.where("batch_id = 'b0'")
    assert store.add(first, clocks).count() == 0
    assert store.table.read().count() == 6
    assert {tuple(r) for r in store.add_in_order(lost.where("batch_id <> 'b0'"), clocks, at_once=1).collect()} == expected
    # a retry of a load after later ones gives the same rows and adds none
    assert store.add(lost.where("batch_id = 'b1'"), clocks).count() == 2 and store.table.read().count() == 11


def test_one_neighbourhood_against_all_pairs():
    rng, at = random.Random(9), {c: i for i, c in enumerate(history.READINGS)}
    for _ in range(30):
        hood, past = history.Neighbourhood(), []
        for n in range(60):
            r = ["1"] * len(history.READINGS)
            r[at["ODO_TOTAL"]], r[at["SPEED"]] = rng.choice(["7", "7.0", "8", "", "7.1", "7,0"]), rng.choice(["3", "3.0", "n/a", "4"])
            r[at["LAT"]] = rng.choice(["1.23456", "1.2346", "1.3", ""])
            number, order = rng.choice([None, 1.0, 2.0]), n // 5
            expected = any(o < order and (c is None or number is None or c == number) and history.same_message(r, x) for c, x, o in past)
            assert hood.found(number, history.SEP.join(r), order) is expected
            past.append((number, r, order))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("1.23", "1.2", True), ("1.25", "1.2", True), ("1.31", "1.2", False), ("26531", "26532", False), ("A", "a  ", True), ("A", "V", False), ("180", "180.0", True), ("-7,5", "-7.50", True), ("x", "--", True), ("0x1F", "OK", False)],
)
def test_same_reading(a, b, same):
    assert history.same_reading(a, b) is same and history.same_reading(b, a) is same


# --- encode ----------------------------------------------------------------

TEXTS = ["", None, "A House.", "<|endoftext|> inside", "Überprüfung – 東京 🙂 ​\xa0", "a\x00b\r\n\t", "x" * 300_000, "é" * 50]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")


def test_ids_against_the_other_library(spark):
    import base64

    import tiktoken

    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in encode.encode(documents(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (other.encode_ordinary(t) if t and len(t) < 1000 else got[i] if t else [])
    assert encode.encode(documents(spark, []).limit(0)).count() == 0


def test_round_trip_and_spans(spark):
    docs = documents(spark, TEXTS)
    back = {r["doc_id"]: r["text"] for r in encode.decode(encode.encode(docs)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    for r in encode.encode_spans(docs).collect():
        text = TEXTS[r["doc_id"]] or ""
        for a, z, b in zip(r["char_starts"], r["char_ends"], r["byte_starts"]):
            assert len(text[:a].encode()) <= b < len(text[:z].encode())
    ids = encode.tokenizer(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}").encode("🙂🙃").ids
    assert "�" in encode.decode_ids(ids[:-1]) and encode.decode_ids(None) == ""


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    t = encode.tokenizer(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}")
    assert encode.decode_ids(t.encode(text, add_special_tokens=False).ids) == text


# --- leaks -----------------------------------------------------------------

FORMULA = "The question is put and agreed to."
ITEMS = [
    (1, "Let us reject that remote windmill through the upper permit, while one northern dairy properly approved her island. Will the famous repair compare our fund of Tovthoperic?"),
    (2, f"{FORMULA} A weary cooper measured the frozen canal behind seven quiet stables before dawn, and nobody in the village counted the broken lanterns."),
    (3, f"{FORMULA} Some copper kettles vanished. My sailor painted every barge twice."),
    (4, f"{FORMULA} Their orchard flooded."),
    (5, None),
    (6, ""),
]
FILLER = "Yesterday an ordinary sentence about pigeons wandered past the harbour without any particular hurry. "


def damaged(text, seed):
    rng = random.Random(seed)
    out = []
    for i, w in enumerate(text.split()):
        if i % 9 == 4:
            continue
        if i % 5 == 2 and len(w) > 4:
            k = rng.randrange(1, len(w) - 2)
            w = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
        out.append(w.upper() if i % 7 == 0 else w)
        if i == 12:
            out.append("[Bell rings]")
    return "  \n".join(out)


def test_leaks(spark):
    p1, p2 = ITEMS[0][1], ITEMS[1][1]
    texts = [
        FILLER * 3 + p1, FILLER + damaged(p1, 1) + FILLER, FILLER + " ".join(p1.split()[5:21]) + ". " + FILLER, FILLER + " ".join(p1.split()[3:11]) + ". " + FILLER,
        FILLER + p2, FILLER + FORMULA + " " + FILLER, "".join(f"{w} {FILLER}" for w in p1.split()), None, "", "   ", FILLER * 3000 + p1, FORMULA + " A weary cooper measured the frozen canal.",
        p1.replace("windmill", "wind-\nmill").replace("a", "а"),
    ]
    texts += [FILLER + FORMULA] * 8
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)] + [(0, texts[0], "x", "x"), (None, p1, "x", "x")], "doc_id bigint, text string, item_id string, matched string")
    items = spark.createDataFrame([(i, p, "x") for i, p in ITEMS], "item_id bigint, passage string, sentence string")
    expected = {(0, 1), (1, 1), (2, 1), (4, 2), (10, 1), (12, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()} == expected
    # the way for held-out sets that are too large to travel with the tasks
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items, leaks.Rules(broadcast_fingerprints=0)).collect()} == expected
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_copies_of_a_leak_are_no_formula(spark, bound):
    long, short, rest = "Let us reject that remote windmill through the upper permit, while one northern dairy properly approved her island.", "Nine copper kettles vanished from our cold crowded northern kitchen.", "My tired sailor painted every barge twice."
    recurs = "Pursuant to the order adopted earlier the committee shall now consider every remaining clause of this bill without further debate."
    rare = "Any plum offends."
    items = spark.createDataFrame([(1, f"{long} {rare}"), (2, f"{short} {rest}"), (3, f"{recurs} {rare}"), (4, f"{recurs} Ponds froze.")], "item_id bigint, passage string")
    rng = random.Random(3)
    told = [" ".join("".join(rng.choices("bcdfgklmnrst" if k % 2 else "aeiou", k=1)[0] for k in range(6)) for _ in range(12)) + ". " for _ in range(8)]
    texts = [(i, f"{FILLER} {long} {FILLER}", None) for i in range(8)]  # copies of one speech
    texts += [(10 + i, f"{x} {long} {x}", None) for i, x in enumerate(told)]  # the same leak in many speeches
    texts += [(20 + i, f"{FILLER} {short} {FILLER}", None) for i in range(8)] + [(30 + i, f"{x} {short} {x}", 30) for i, x in enumerate(told)]  # copies, and reissues of one speech
    texts += [(40, f"{FILLER} {short} {rest}", None)] + [(50 + i, f"{x} {recurs} {x}", None) for i, x in enumerate(told)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, reissue_of bigint")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items, leaks.Rules(broadcast_fingerprints=bound)).collect()}
    assert found == {(i, 1) for i in [*range(8), *range(10, 18)]} | {(40, 2)}
    # short and alone in many speeches: a formula
    others = spark.createDataFrame([(60 + i, f"{x} {short} {x}", None) for i, x in enumerate(told)], docs.schema)
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs.unionByName(others), items, leaks.Rules(broadcast_fingerprints=bound)).collect()}
    assert found == {(i, 1) for i in [*range(8), *range(10, 18)]}


def test_leaks_are_found_however_often_they_leak(spark):
    """One sentence of 20 words or two of 11, each in 1, 5, 50 or 500 documents with other texts around it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfgklmnrst" if k % 2 else "aeiou", k=1)[0] for k in range(rng.randrange(4, 9)))
    some = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passages = {10 * k + n: some(20) if n == 1 else f"{some(11)} {some(11)}" for k in range(4) for n in (1, 2)}
    texts, expected = [], set()
    for item, passage in passages.items():
        for _ in range((1, 5, 50, 500)[item // 10]):
            expected.add((len(texts), item))
            texts.append(f"{some(30)} {passage} {some(30)}")
    docs = spark.createDataFrame(list(enumerate([*texts, *(some(80) for _ in range(50))])), "doc_id bigint, text string")
    items = spark.createDataFrame(list(passages.items()), "item_id bigint, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()} == expected


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_a_formula_elsewhere_hides_no_leak(spark, bound):
    formula = "The honourable member for the northern district will now resume the seat at once."
    passage = f"{formula} A weary cooper measured the frozen canal behind seven quiet stables before dawn, and nobody counted broken lanterns."
    items = spark.createDataFrame([(1, passage), (2, f"{formula} Ponds froze."), (3, f"{formula} Kettles sang.")], "item_id bigint, passage string")
    own = passage[len(formula) :].split()
    spread = " ".join(w if i % 3 else f"{w} indeed" for i, w in enumerate(own))
    texts = [f"{formula} {FILLER * 30} {spread} {FILLER * 30} {formula}", f"{spread} {FILLER * 30} {formula} {FILLER * 30}", f"{formula} {FILLER * 30} {' '.join(own[:9])}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items, leaks.Rules(broadcast_fingerprints=bound)).orderBy("doc_id").collect()] == [(0, 1), (1, 1)]


def test_both_ways_find_the_same_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghiklmnoprstuvwxyz", k=n))
    passages = [[word(rng.randrange(2, 9)) for _ in range(24)] for _ in range(60)]
    # one or two shared spans of few letters each: a fingerprint at a span's end may be picked on one side only
    texts = [" ".join([word(6), *p[k : k + 16], word(6)]) for p in passages for k in (0, 4)]
    texts += [" ".join(x for i in range(0, 24, 4) for x in (*p[i : i + 3], word(5))) for p in passages]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id bigint, passage string")
    rules = [leaks.Rules(min_hits=12, broadcast_fingerprints=n) for n in (2_000_000, 0)]
    a, b = ({tuple(r) for r in leaks.carried_sentences(docs, items, x).select("doc_id", "item_id", "matched", "place").collect()} for x in rules)
    assert a == b and len(a) > 100


def test_repeated_letters_pass_alone_as_among_others():
    text, rules = "so " + "ab" * 8 + " no", leaks.Rules(min_hits=6)
    passage = " ".join(["ab" * 12] * 2)
    alone = [x[0] for x in leaks.Index([(1, passage)], rules).carried(text)]
    among = [x[0] for x in leaks.Index([(1, passage), (2, text)], rules).carried(text)]
    assert alone == [1] and 1 in among


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40), st.text("abcd", min_size=12, max_size=30))
def test_winnowing_guarantee(left, right, shared):
    def prints(s):
        h = leaks.kgram_hashes(leaks._codes(s), 9)
        return set(h[leaks.winnow(h, 4)].tolist())

    assert prints(left + shared) & prints(shared + right)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=12))
def test_alignment_is_a_longest_common_subsequence(a, b):
    a, b = [x * 2 for x in a], [x * 2 for x in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    pairs = leaks.Item(1, " ".join(a)).align(b) if a else []
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


# --- truncation ------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("All is well.", False), ("Is it?", False), ("Broken off—", False), ("Broken off --", False), ("Noted. [Laughter]", False), ('He said: "Enough."', False), ("(Applause.)", False), ("It stopped in the mid", True),
        ("It stopped...", True), ("It stopped…", True), ("It stopped. . .", True), ("A comma,", True), ("Then (A Member: Th", True), ("Then (A Member: That is not so.", True), ('He said: "Eno', True),
        ('He said: "Enough.', True), ("Ended.  \n​\xa0", False), ("bad byte �", True), ("ends &am", True), ("ends <b", True), (None, False), ("", False), (" \n", False), ("終わった。", False),
        ("since (", True), ("in 337", True), ("An “open quote", True), ("» gut.", False), ("smile :( " + "Then much more was said here. " * 20, False),
    ],
)
def test_cut(spark, text, cut):
    docs = spark.createDataFrame([(1, text, None, "x")] + [(i, "Whole.", None, "x") for i in range(2, 6)], "doc_id bigint, text string, source string, ending string")
    assert [r[0] for r in truncation.cut_texts(docs).collect()] == ([1] if cut else [])


@pytest.mark.parametrize(
    ("text", "ending"),
    [
        ("One (two " + "and then three. " * 60, "open"), ("He said: “Well. " + "And more was said. " * 200, "open"), ("<div><p>Text.", "open"), ("<div><p>Text.</p></div>", "terminated"), ("<p>One.<br>Two.</p>", "terminated"),
        ("<DIV>(a) <b>x</b> is (so).</div>", "terminated"), ("Sad :( but whole.", "terminated"), ('He wrote \\"so.', "terminated"), ("See <a href=\"http://x/" + "y" * 500, "broken"), ("ends \\u00", "broken"), ("up 5 %2", "broken"),
        ("If a <b then it holds, as said.", "terminated"), ("(a [b) is whole.", "terminated"), ("<inaudible> was said.", "terminated"), ("x" * 100_000 + ".", "terminated"),
    ],
)
def test_stack_of_marks_and_tags(text, ending):
    assert truncation.ending(text)[0] == ending


def test_a_parked_device_is_few_rows():
    import numpy as np

    rng, rules = np.random.default_rng(4), runs.Rules()
    us = np.arange(5000) * 17_000_000
    lat, lon = 10 + rng.normal(0, 5e-5, 5000), 20 + rng.normal(0, 5e-5, 5000)
    parked = list(runs.day_parts("d", us, lat, lon, rules))
    assert len(parked) == 1 and parked[0][7] == "circle"
    moving = list(runs.day_parts("d", us, lat + np.arange(5000) * 2e-4, lon, rules))  # 22 m a step: no sure boundary
    assert sum(r[7] != "run" for r in moving) < 500


def test_walks_cut_anywhere_meet_again():
    import numpy as np

    rng, rules = random.Random(1), runs.Rules()
    for trial in range(150):
        us, lat, points, kind = 0, rng.uniform(-60, 60), [], rng.randrange(4)
        for _ in range(rng.randrange(1, 120)):
            us += 1_000_000 * rng.choice([30, 600, 4000, 21_600, 21_601] if kind < 2 else [60, 300])
            lat += rng.choice([0, 0, 2e-4, -2e-4, 4e-4, 9e-4, 0.01]) if kind == 0 else rng.gauss(0, 1e-4) if kind == 1 else 0
            points.append((us, lat + (rng.gauss(0, 1.5e-4) if kind > 1 else 0) + (0.01 if kind == 3 and rng.random() < 0.03 else 0), 5.0 + (rng.gauss(0, 1e-4) if kind > 1 else 0)))
        cuts = [0, *sorted(rng.sample(range(1, len(points)), min(len(points) - 1, rng.randrange(6)))), len(points)]
        parts = [r for a, b in zip(cuts, cuts[1:]) for r in runs.day_parts("d", *(np.array(c) for c in zip(*points[a:b])), rules)]
        got, walk = [r[1:4] for r in parts if r[7] == "run"], runs.Boundaries(rules)
        for _, first, last, n, y, x, circle, what, body in sorted((r for r in parts if r[7] != "run"), key=lambda r: r[1]):
            if what == "fresh":
                got += filter(None, [walk.fresh(first, y, x, n, last)])
            elif what == "event" or not walk.holds(first, last, y, x, circle, n):
                t, p = (np.array([first]), np.array([y, x])) if what == "event" else (np.frombuffer(body, np.int64, n), np.frombuffer(body, np.float64, 2 * n, 8 * n))
                got += walk.push(t, p[:n], p[n:])
        got += filter(None, [walk.end()])
        assert sorted(got) == [(a * 1_000_000, b * 1_000_000, n) for a, b, n in slow_runs([(t / 1e6, y, x) for t, y, x in points])], trial


def test_baseline_of_a_source(spark):
    rows = [(i, "no terminator here" + " x" * (i % 4), "titles", "x") for i in range(20)] + [(100, "y" * 300, "titles", "x"), (101, "Whole.", "prose", "x"), (102, "cut he", "prose", "x"), (103, "Also whole!", "prose", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, ending string")
    assert {r[0] for r in truncation.cut_texts(docs).collect()} == {100, 102}
    rates = {r["source"]: tuple(r)[1:] for r in truncation.cut_rates(docs).collect()}
    assert rates == {"titles": (21, 1, 0.047619), "prose": (3, 1, 0.333333)}
    assert truncation.cut_texts(docs.limit(0)).count() == 0


def test_words_broken_where_bare_ends_prevail(spark):
    title = "Minutes of the northern harbour committee about pigeons"
    rows = [(i, title if i % 2 else f"{title} and lanterns {i}", "titles") for i in range(20)]
    rows += [(20 + i, f"{title[: -k]}", "titles") for i, k in enumerate((2, 4, 10, 17))]  # pigeo, pige, abo, committ
    rows += [(30, f"{title} Zelfapelin", "titles"), (31, f"{title} in 1907", "titles"), (32, title + " and Harbour", "titles"), (33, None, "titles"), (34, f"{title} with a longest line of all of them", "titles")]
    rows += [(100 + i, f"{title} was read.", "prose") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r[0] for r in truncation.cut_texts(docs).collect()} == {20, 21, 22, 23, 34}
    rates = {r["source"]: (r["text_count"], r["cut_count"]) for r in truncation.cut_rates(docs).collect()}
    assert rates == {"titles": (28, 5), "prose": (4, 0)}
