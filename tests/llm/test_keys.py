"""Keys of rows, indexes and pseudonyms: what goes back, what is linked, what is left behind."""

import hashlib
import random

from sqlverdict.llm import exact_dedup, lpf, pii

TEXT = "doc_id long, text string"


# 4: exact duplicates


def test_an_index_by_path_and_none_left(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    index = lambda: exact_dedup.DigestIndex(spark, "digests_by_path", 3, "string", f"file://{tmp_path}/index")
    first = {r.doc_id: r for r in exact_dedup.deduplicate(frame(("b", "x  y"), ("a", "x\ty"), ("c", None)), index()).collect()}
    assert [(k, first[k].kept, first[k].keep_id) for k in "abc"] == [("a", True, "a"), ("b", False, "a"), ("c", True, "c")]
    second = {r.doc_id: r for r in exact_dedup.deduplicate(frame(("d", "x y"), ("e", "new"), ("f", "")), index()).collect()}
    assert [(second[k].kept, second[k].keep_id) for k in "def"] == [(False, "a"), (True, "e"), (False, "c")]
    assert index().buckets == 3
    assert index().read().count() == 3
    index().drop()
    assert not spark.catalog.tableExists("digests_by_path")
    assert not (tmp_path / "index").exists()
    before = [t.name for t in spark.catalog.listTables()]
    assert exact_dedup.deduplicate(frame(("a", "x"), ("b", "x"))).where("kept").count() == 1
    assert [t.name for t in spark.catalog.listTables()] == before


def test_ties_are_settled_by_content(spark):
    rows = [(1, "a  b", "x"), (1, "a b", "y"), (1, "a\tb", "z"), (2, "c", "x")]
    kept = lambda order: sorted(map(tuple, exact_dedup.keep_first(spark.createDataFrame(order, "doc_id long, text string, other string")).collect()))
    assert len(kept(rows)) == 2
    assert kept(rows) == kept(rows[::-1]) == kept(rows[1:] + rows[:1])


# 5: pseudonyms


def luhn_digit(d):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return str(-total % 10)


def test_pseudonyms_go_back(spark):
    r = random.Random(7)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    cards = [d + luhn_digit(d) for d in (digits(k) for k in (12, 15, 15, 18))]
    values = [
        *cards,
        " ".join(cards[1][i : i + 4] for i in range(0, 16, 4)),
        *[f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(8)],
        *[f"{r.randint(1800, 2199)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" for _ in range(6)],
        *[f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" for _ in range(6)],
        *[".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(6)],
        "Jo.Smith-9@Mail.example.com",
        "abcd@b.org",
        "AKIA" + "".join(r.choice("ABCXYZ0189") for _ in range(16)),
        "password=Ab3defgh9",
        'token = "0123456789abcdefXYZ"',
        "(988) 555-2485",
        "988-555-2485",
        "988.555.2485",
        "+49 151 2345678",
        "+442079460958",
        "sk-" + "aZ09" * 6,
        "ghp_" + "abcd" * 9,
        "password=4041894974608795",
    ]
    texts = [f"before {v} after" for v in values] + ["nothing", "", " and ".join(values[:1] + values[5:])]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXT)
    hidden = pii.pseudonymize(docs, "one key")
    there = {x.doc_id: x.text for x in hidden.collect()}
    shape = lambda t: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in t)
    assert all(there[i] != t for i, t in enumerate(texts[: len(values)]))
    assert all(shape(there[i]) == shape(t) for i, t in enumerate(texts[: len(values)]) if t.count(".") != 3)
    assert {x.doc_id: x.text for x in pii.restore(hidden, "one key").collect()} == dict(enumerate(texts))
    other = {x.doc_id: x.text for x in pii.restore(hidden, "another key").collect()}
    assert all(other[i] != t for i, t in enumerate(texts[: len(values)]))


def test_an_address_is_linked_in_any_case(spark):
    forms = ["Ann.Lee@mail.com", "ann.lee@mail.com", "ANN.LEE@mail.com", "ann.le@mail.com"]
    found = [x.text for x in pii.pseudonymize(spark.createDataFrame(list(enumerate(forms)), TEXT), "k").orderBy("doc_id").collect()]
    assert len({t.lower() for t in found[:3]}) == 1
    assert [[c.isupper() for c in t] for t in found] == [[c.isupper() for c in t] for t in forms]
    assert found[3].lower() != found[0].lower()


def test_phones_are_linked_in_any_layout(spark):
    forms = ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "988.555.2485", "call 988-555-2485.", "7 988-555-2485 4041894974608795", "+49 151 2345678", "+491512345678", "+49 (151) 2345678 2031-01-02"]
    rows = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(forms)), TEXT), "k", found_col="n").collect()}
    digits = lambda k: "".join(c for c in rows[k].text if c.isdigit())
    plan, abroad = digits(1), digits(7)
    assert plan != "9885552485"
    assert len(plan) == 10
    assert [digits(k) for k in range(6)] == ["1" + plan, *[plan] * 4, "7" + plan + digits(5)[11:]]
    assert abroad[:2] == "49"
    assert abroad != "491512345678"
    assert digits(6) == digits(8)[:-8] == abroad
    assert [rows[k].n for k in range(9)] == [1] * 5 + [2, 1, 1, 2]


def test_long_addresses_are_permuted(spark):
    plain = ["2001:db8:85a3::8a2e:370:7334", "fe80:0:0:0:202:b3ff:fe1e:8329", "aa:bb::c", "aaaa:bbbb:cccc:dddd:eeee:ffff:abcd:fade"]
    frame = spark.createDataFrame([*enumerate(plain), (4, plain[0].upper()), (5, "a:b:c:d:e::1:2:3:4"), (6, "std::vector 10:20:30 aa:bb:cc:dd:ee:ff")], TEXT)
    hidden = pii.pseudonymize(frame, "k")
    found = {r.doc_id: r.text for r in hidden.collect()}
    for k, t in enumerate(plain):
        assert found[k] != t
        assert [len(g) for g in found[k].split(":")] == [len(g) for g in t.split(":")]
        assert set(found[k]) <= set("0123456789abcdef:")
    assert found[4] == found[0]
    assert (found[5], found[6]) == ("a:b:c:d:e::1:2:3:4", "std::vector 10:20:30 aa:bb:cc:dd:ee:ff")
    back = {r.doc_id: r.text for r in pii.restore(hidden, "k").collect()}
    assert [back[k] for k in range(5)] == [*plain, plain[0]]


def test_what_only_looks_like_a_value_stays(spark):
    texts = ["188-555-2485", "1-988-555-2485-7", "988-155-2485", "+1512", "+49 151", "2 + 34567890123456789", "password=abcdefgh@", "sk-short", "12 345 678"]
    found = [r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), TEXT), "k").orderBy("doc_id").collect()]
    assert found == texts


def test_the_key_is_the_session_s(spark):
    session = spark.newSession()
    assert pii.key_of(session) == pii.TEST_KEY
    session.conf.set(pii.KEY_SETTING, "secret")
    assert pii.key_of(session) == "secret"


# 6: repeats, as the registered query removes them


def test_all_copies_go_on_odd_rows(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(4000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "x" * 500), (None, long[1000:1500]), (None, "short"), (5, "é" * 150 + long[3000:3199]), (6, long[:100] + long[100:300] + "!" * 150)]
    data = [(t or "").encode() for _, t in rows]
    places = {}
    for d in data:
        for i in range(len(d) - 199):
            places[d[i : i + 200]] = places.get(d[i : i + 200], 0) + 1
    want = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if places[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((str(k), len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    found = lpf.remove_repeats(spark.createDataFrame(rows, TEXT), keep_first=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(want)
