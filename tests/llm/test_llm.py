import random

import pytest
from pyspark.sql import functions as F

from specloom.llm import canon_map, entity_match, fusion, leakage, packing, sentences

OPEN = "rec_id long, manufacturer string, model string, openmsx_id string, year int, generation string, vdp string, main_ram_kb int, vram_kb int, fm_chip string, floppy_drives string, keyboard_layout string, scraped_cart_slots int"
WIKI = OPEN.replace("openmsx_id", "msxorg_title")


def o(i, maker, model, oid=None, **kw):
    return (i, maker, model, oid, kw.get("year"), None, kw.get("vdp"), kw.get("ram"), None, None, None, None, None)


def test_entity_match(spark):
    left = spark.createDataFrame([o(1, "Kastudox", "ABC-123P", year=1985, vdp="V", ram=64), o(2, "KASTUDOX", "abc 123P"), o(3, "Kastudox", "ABC-123mkII"), o(4, "Zenith", "XYZ 5043/20"), o(5, None, None), o(6, "Kastudox", "ABC-123"), o(7, "Ferlori", "QQ 500+", "Ferlori_QQ-500+")], OPEN)
    right = spark.createDataFrame(
        [o(101, "Kastudox Co., Ltd.", "ABC_123 P (v1)", "x"), o(102, "Kastdox", "ＡＢＣ‑１２３ Mk2 / ABC-123P", None), o(103, None, "Zenith XYZ-5O43.20", "Zenith XYZ"), o(104, "Other (Manufacturer: Kastudox)", "123P", "Kastudox ABC-123P"), o(105, None, None, None), o(106, "Kastudox", "ABC-123R", None), o(107, "Ferlori", "QQ500 plus", None)], WIKI
    )
    got = entity_match.match(left, right)
    pairs = {(r.openmsx_rec_id, r.msxorg_rec_id) for r in got.collect()}
    assert pairs == {(1, 101), (2, 101), (3, 102), (1, 102), (2, 102), (4, 103), (1, 104), (2, 104), (7, 107)}
    assert all(0 < r.confidence < 1 for r in got.collect())
    labels = spark.createDataFrame([(1, 101, True), (2, 101, False)], "openmsx_rec_id long, msxorg_rec_id long, is_match boolean")
    conf = {r.rule: r.confidence for r in entity_match.match(left, right, labels=labels).collect()}
    assert conf["maker+model"] == 0.5
    assert entity_match.match(left.limit(0), right).count() == entity_match.match(left, right.limit(0)).count() == 0
    rows, members = entity_match.classes(left, right)
    many = {(r.class_maker, r.class_mark): (r.n_openmsx, r.n_msxorg) for r in rows.collect()}
    assert many["KASTUDOX", "ABC123P"] == (2, 3) and many["KASTUDOX", "ABC123MK11"] == (1, 1)
    at = {}
    for m in members.collect():
        at.setdefault((m.class_maker, m.class_mark), {"openmsx": set(), "msxorg": set()})[m.source].add(m.rec_id)
    assert {(a, b) for c in at.values() for a in c["openmsx"] for b in c["msxorg"]} == pairs


def test_entity_match_rules_one_by_one(spark):
    """One page per rule, each with a sibling of another maker; the weaker rules must not fire where a stronger one did."""
    left = spark.createDataFrame([o(k, m, f"ABC-{k}00") for k, m in enumerate(["Kastudox", "Kastudox", "Kastudox", "Kastudox", "Kastudox"], 1)] + [o(k + 10, "Zenith", f"ABC-{k}00") for k in range(1, 6)], OPEN)
    right = spark.createDataFrame(
        [o(101, "Kastudox", "ABC 100", "x"), o(102, "Other", "ABC 200", "Kastudox thing"), o(103, "Other", None, "Kastudox ABC 300"), o(104, "Kastdox", "ABC 400", None), o(105, "Kastdox", None, "Unheard ABC 500"), o(106, "Nobody", "ABC 100", None)], WIKI
    )
    got = {(r.openmsx_rec_id, r.msxorg_rec_id, r.rule) for r in entity_match.match(left, right).collect()}
    assert got == {(k, 100 + k, r.name) for k, r in enumerate(entity_match.RULES, 1)}


def test_silver_labels_measure_rules(spark):
    """Pairs whose facts agree raise a rule's confidence, others lower it; a rule that can't be judged has the blank one."""
    left = spark.createDataFrame([o(k, "Acme", f"ABC-{k}", year=1980, vdp="V", ram=64) for k in range(100, 110)] + [o(1, "Zenith", "XYZ-500")], OPEN)
    right = spark.createDataFrame([o(1000 + k, "Acme", f"ABC {k}", None, year=1980 if k < 108 else 1, vdp="v" if k < 108 else "w", ram=64) for k in range(100, 110)] + [o(2, "Zenth", "XYZ 500", None)], WIKI)
    conf = {r.rule: r.confidence for r in entity_match.match(left, right).collect()}
    assert conf["maker+model"] == pytest.approx(9 / 12) and conf["model, maker alike"] == 0.5


def test_large_classes_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(entity_match, "LARGE", 7)
    left = spark.createDataFrame([o(k, "Acme", "ABC-1") for k in range(40)] + [o(99, "Acme", "ABC-2")], OPEN)
    right = spark.createDataFrame([o(100 + k, "Acme", "abc_1", None) for k in range(5)] + [o(199, "Acme", "ABC 2", None)], WIKI)
    got = [(r.openmsx_rec_id, r.msxorg_rec_id) for r in entity_match.pairs(left, right).collect()]
    assert sorted(got) == sorted([(a, 100 + b) for a in range(40) for b in range(5)] + [(99, 199)])


def test_map_models(spark):
    canon = spark.createDataFrame([(1, "Acme", "AB-1234P"), (2, "Acme", "AB-1234"), (3, "Zenith", "QX 720mkII"), (4, "Zenith", "QX 720II"), (5, "Acme", "CD-5678W")], "canon_id long, manufacturer string, model string")
    typed = ["ab 1234p", "AB/1234 (ES)", "Zenith QX720 Mk2", "QX-720II/model 1", "AB-1234R", "CD-567W", "CD-5778W", "CD-56t8W", "home-built clone", "", None, "  ", "CDD-5678W", "C5D-678W", "CD-567W8", "AB-1Z34P", "A-1234P", "X-1234P"]
    got = {r.id: r.canon_id for r in canon_map.map_models(spark.createDataFrame([(i, None if i % 2 else "Acme Corp.", t) for i, t in enumerate(typed)], "entry_id long, match_manufacturer string, match_model string"), canon).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: -1, 5: 5, 6: -1, 7: 5, 8: -1, 12: 5, 13: 5, 14: 5, 15: 1, 16: 1, 17: -1}


def test_repair_meets_several_lookalikes(spark):
    typed = spark.createDataFrame([("AB1O1O",), ("ABIOO",), ("ABIO9",)], "token string")
    meant = spark.createDataFrame([("AB1010",), ("AB100",)], "word string")
    got = {(r.token, r.word): round(r.cost, 1) for r in canon_map.repair(typed, meant).collect()}
    assert got["AB1O1O", "AB1010"] == 0.4 and got["ABIOO", "AB100"] == 0.6 and got["ABIOO", "AB1010"] == 1.6 and ("ABIO9", "AB100") not in got


def test_map_regions(spark):
    canon = spark.createDataFrame([(1, "Japan", "jp", "日本"), (2, "Saudi Arabia", "sa", "السعودية"), (3, "Iran", "ir", "ایران"), (4, "Iraq", "iq", "العراق"), (5, "UK", "gb", "United Kingdom"), (6, "Italy", "it", "Italia")], "region_id long, region string, code string, local_name string")
    typed = ["japan", "JP - Japan", "日本 / Iran", "Saudi Aarbia; ITALY", "worldwide", None, " ", "Iraq", "United ingdom only", "(IT)", "Japn (export version)", "Atlantis", "iran, late model", "JAPAN", "Great Britain", "Japan only", "Italy only", "only Iraq"]
    rows = canon_map.map_regions(spark.createDataFrame(list(enumerate(typed)), "rec_id long, region string"), canon).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.canon_id)
    assert got == {0: {1}, 1: {1}, 2: {1, 3}, 3: {2, 6}, 4: {-1}, 7: {4}, 8: {5}, 9: {6}, 10: {1}, 11: {-1}, 12: {3}, 13: {1}, 14: {5}, 15: {1}, 16: {6}, 17: {4}}


def test_typing_cost():
    assert canon_map.typing_cost("AB12", "AB12") == 0 and canon_map.typing_cost("A12", "AB12") == 1 and canon_map.typing_cost("BA12", "AB12") == 1
    assert canon_map.typing_cost("AB13", "AB12") > 1.6 and canon_map.typing_cost("ABB12", "AB12") == 1 and canon_map.typing_cost("AXB12", "AB12") == 1.5 and canon_map.typing_cost("ABl2".upper(), "AB12") == pytest.approx(0.2)


LOCAL = "rec_id long, manufacturer string, model string, origin string, edited_at timestamp, vdp string, keyboard_layout string, region string, main_ram_kb int"


def test_fusion(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, " Acme", "X　", "low", t(9), "V1", "n/a", "--", 0), (2, "ACME", "x", "top", None, "v2", "?", None, 64), (3, "acme", "x", "top", t(1), "V3", " ", "", 128), (4, "acme", "x", "top", t(1), "V4", "to be checked", "(none)", -1),
        (5, "solo", "y", "top", t(1), "V", "K", "R", 1), (6, None, None, "??", t(2), "V", "K", None, 3), (7, None, "", None, t(2), "W", None, None, None),
    ]
    df = spark.createDataFrame(rows, LOCAL)
    origins = spark.createDataFrame([("low", 0), ("top", 3)], "origin string, trust int")
    got = {(r.group_key, r.field_name): r.rec_id for r in fusion.precedence(df, origins).collect()}
    assert got == {("acme|x", "vdp"): 3, ("acme|x", "main_ram_kb"): 3, ("|", "vdp"): 6, ("|", "keyboard_layout"): 6, ("|", "main_ram_kb"): 6}
    s = {r.group_key: r for r in fusion.survivors(df, origins).collect()}
    assert s["acme|x"].n_rows == 4 and s["acme|x"].vdp == "V3" and s["acme|x"].region is None and s["solo|y"].region == "R"
    assert fusion.precedence(df.limit(0), origins).count() == 0


def test_truth_discovery_learns_sources(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for g in range(60):
        for origin, p in (("good", 0.95), ("fair", 0.8), ("bad", 0.3), ("bad2", 0.3)):
            i += 1
            rows.append((i, "m", str(g), origin, None, f"V{g}" if rng.random() < p else f"W{rng.randrange(3)}", None, None, None))
    df = spark.createDataFrame(rows, LOCAL)
    origins = spark.createDataFrame([(x, 0) for x in ("good", "fair", "bad", "bad2")], "origin string, trust int")
    found, weight = fusion.truth_discovery(df, origins)
    right = sum(r.value == "V" + r.group_key.split("|")[1] for r in found.collect())
    assert right >= 54 and weight["good"] > weight["fair"] > weight["bad"]
    assert fusion.truth_discovery(df.limit(0), origins)[0].count() == 0


def test_truth_discovery_settles_or_says_so(spark):
    df = spark.createDataFrame([(i, "m", str(i // 3), o, None, v, None, None, None) for i, (o, v) in enumerate([("a", "V"), ("b", "V"), ("c", "W")] * 9)], LOCAL)
    origins = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4)], "origin string, trust int")
    found, _ = fusion.truth_discovery(df, origins)
    assert {r.value for r in found.collect()} == {"W"}
    with pytest.raises(RuntimeError):
        fusion.truth_discovery(df, origins, rounds=1)


def test_plan_is_whole_and_tight():
    rng = random.Random(2)
    for cap in (1, 7, 64, 256):
        hist = {}
        for _ in range(400):
            n = rng.randrange(1, cap + 1)
            hist[n] = hist.get(n, 0) + 1
        left = dict(hist)
        bins = 0
        for times, combo in packing.plan(hist, cap):
            assert sum(s * k for s, k in combo.items()) <= cap
            bins += times
            for s, k in combo.items():
                left[s] -= k * times
        assert not any(left.values()) and bins <= 1.35 * -(-sum(s * c for s, c in hist.items()) // cap) + 2
    assert packing.fullest([5, 4, 3], {5: 1, 4: 1, 3: 2}, 10) == {4: 1, 3: 2} and packing.fullest([5], {5: 1}, 0) == {} and packing.plan({}, 8) == []


def test_pack(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([0, None, 3, 5, 8, 17, 8, 3, 5] + [4] * 50)], "doc_id long, n_tokens long")
    packs = spark.createDataFrame([(1, 8), (2, 20)], "pack_id long, capacity_tokens int")
    rows = packing.pack(sizes, packs, per_salt=7).collect()
    room = {1: 8, 2: 20}
    fill, own = {}, {}
    for r in rows:
        fill[r.pack_id, r.container_no] = fill.get((r.pack_id, r.container_no), 0) + r.n_tokens
        own.setdefault((r.pack_id, r.doc_id), []).append((r.start_token, r.n_tokens))
    assert all(v <= room[k[0]] for k, v in fill.items()) and len(own) == 2 * 59
    assert sorted(own[1, 5]) == [(0, 8), (8, 8), (16, 1)] and own[2, 5] == [(0, 17)]
    assert len([k for k in fill if k[0] == 1]) == -(-sum(n for n in [3, 5, 8, 17, 8, 3, 5] + [4] * 50) // 8)


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "hello hello"), (2, None), (3, ""), (4, "<|endoftext|>" + "x" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(df).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 5


WORDS = [f"w{i}" for i in range(300)]


def brute(text, item, run=12, edits=0.25):
    t, w = leakage.words(text), leakage.words(item)
    grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    if any(tuple(t[i : i + run]) in grams for i in range(len(t) - run + 1)):
        return True
    for s in item.split("."):
        s = leakage.words(s)
        if len(s) < 2:
            continue
        row = list(range(len(s) + 1))
        for x in t:
            nxt = [0]
            for j in range(1, len(s) + 1):
                nxt.append(min(row[j - 1] + (s[j - 1] != x), row[j] + 1, nxt[j - 1] + 1))
            row = nxt
            if row[-1] <= int(len(s) * edits):
                return True
    return False


def test_long_tags_are_no_words():
    run = [f"w{i}" for i in range(14)]
    tag = '<a href="https://example.org/' + "x/y-z." * 30 + '" title="one\ntwo. Three">'
    assert leakage.words(f"{run[0]} {tag}{run[1]}</a> <b\nclass=q>{run[2]}") == run[:3]
    assert leakage.words("a <b and " + "c " * 60 + "> d") == ["a", "b", "and", *["c"] * 60, "d"]
    index = leakage.ItemIndex([(7, f"Zz {tag}{' '.join(run)}</a>.")])
    assert index.leaks(" ".join(run[:6]) + f" {tag}" + " ".join(run[6:]) + "</a>")


def test_leaks_equal_brute_force():
    rng = random.Random(3)
    sent = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, ". ".join(sent(rng.randrange(14, 30)) for _ in range(4)) + ".") for k in range(40)]
    index = leakage.ItemIndex(items, block=8)
    for _ in range(24):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = leakage.words(rng.choice(items)[1])
            a = rng.randrange(len(w))
            piece = w[a : a + rng.randrange(8, 40)]
            for _ in range(rng.randrange(0, 9)):
                k = rng.randrange(len(piece))
                piece[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [piece[k], "zzz"]])
                piece = piece or ["q"]
            parts += [" ".join(piece), sent(rng.randrange(0, 250))]
        text = " ".join(parts)
        assert {index.ids[k] for k in index.leaks(text)} == {i for i, t in items if brute(text, t)}


def test_find_leaks(spark):
    item = "The night porter borrowed three silver screws with a wooden ruler near the canal. Who acted alone?"
    other = "A sleepy clerk hid four unlabelled tapes under two wool blankets after the storm had passed. Who acted alone?"
    ja = "地下の書庫で厳しい先生が大理石の机の上で記憶素子の箱を隠しやがて若い記録係が予備の変圧器を片付けた。"
    docs = [
        (1, "x <b>THE</b> nìght pоrter *borrowed* three silver screws, with a wooden ruler near"), (2, "the night porter borrowed three silver screws"), (3, "Who acted alone?"), (4, None), (5, ""), (6, "記" + ja[:32]), (7, ja[:25]),
        (8, "a night porter borrowed three gold screws with a wooden ruler near canal"), (1, "x"), (9, "zz " * 3000 + other),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(10, item), (11, other), (12, ja), (13, None), (14, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, it).collect()}
    assert got == {(1, 10), (6, 12), (8, 10), (9, 11)}
    for size in (40, 150, 400):  # several blocks
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, it, block_bytes=size).collect()} == got
    named = it.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, named, block_bytes=150).collect()} == {(a, f"i{b}") for a, b in got}
    # a question that both items ask is reported for both if that is asked for
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, it, stock=True).collect()} == got | {(3, 10), (3, 11), (9, 10)}
    share = {(r.doc_id, r.item_id): (r.passage_share, r.question_share) for r in leakage.leak_overlaps(d, it).collect()}
    assert set(share) == got and share[9, 11] == (1.0, 1.0) and share[1, 10][0] > 0.7 and share[1, 10][1] == 0 and share[6, 12][1] is None
    assert leakage.find_leaks(d, it.limit(0)).count() == leakage.find_leaks(d.limit(0), it).count() == 0


def cut(t):
    return [t[a:b] for a, b in sentences.sentence_spans(t)]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Who of Acme Co. Ltd. paid 1.5 A, not 15 A. The rest (cf. p. 3) left at 9 a.m. It rained.", ["Dr. Who of Acme Co. Ltd. paid 1.5 A, not 15 A.", "The rest (cf. p. 3) left at 9 a.m.", "It rained."]),
        ('It said "Do not open. No parts." on the lid. "Go!" said Ann. (He left.) Bye', ['It said "Do not open. No parts." on the lid.', '"Go!" said Ann.', "(He left.)", "Bye"]),
        ("One line\nwraps here. Two :-) Three!\n\nHead\n\n- a. b\n- c", ["One line\nwraps here.", "Two :-)", "Three!", "Head", "- a. b", "- c"]),
        ("Am 3. Mai kam er, z. B. mit usw. Dann ging er.", ["Am 3. Mai kam er, z. B. mit usw.", "Dann ging er."]),
        ("価格は5円。「起動！」と言った。（ただし除く。）終", ["価格は5円。", "「起動！」と言った。", "（ただし除く。）", "終"]),
        ("เปิดแล้วครับ ราคา 5 บาทค่ะ จบ", ["เปิดแล้วครับ", "ราคา 5 บาทค่ะ", "จบ"]),
        ("EE. UU. recibió otra. ¿Y el cable? ¡Sí!", ["EE. UU. recibió otra.", "¿Y el cable?", "¡Sí!"]),
        ("Он из г. Norvik. Вышла в 1987 г. с памятью.", ["Он из г. Norvik.", "Вышла в 1987 г. с памятью."]),
        ("यह है। डॉ. राम आए।", ["यह है।", "डॉ. राम आए।"]),
        ("Version 3.11 runs.It works... mostly", ["Version 3.11 runs.", "It works... mostly"]),
        ('Unclosed "quote here. Next one.', ['Unclosed "quote here.', "Next one."]),
        (" \n\n ", []), ("", []), (None, []),
    ],
)
def test_sentences(text, parts):
    assert cut(text) == parts if text else sentences.sentence_spans(text) == parts


def test_nested_lists_and_deep_quotations():
    text = "Parts:\n1. Board.\na) Left side.\nb) Right side.\n2. Case. It is big.\nIt weighs\n3) kilos.\n- Loose ends.\n3. Cable."
    assert cut(text) == ["Parts:", "1. Board.", "a) Left side.", "b) Right side.", "2. Case.", "It is big.", "It weighs\n3) kilos.", "- Loose ends.", "3. Cable."]
    inner = "Stop. " * 3
    deep = "He read " + "".join("([{«"[k % 4] for k in range(12)) + inner + "".join(")]}»"[k % 4] for k in reversed(range(12))) + " aloud. Then he left."
    assert cut(deep) == [deep[: deep.index(" Then")], "Then he left."]
    # a quotation that never closes hides nothing, whatever is open inside it
    assert cut('"One (two. Three) four. Five. Six') == ['"One (two. Three) four.', "Five.", "Six"]
    many = "(" * 5000 + " Alpha ran. Beta sat. " + "]" * 5000
    assert cut(many)[1].startswith("Beta sat.")


def test_time_is_linear():
    import time

    def took(text):
        at = time.perf_counter()
        sentences.sentence_spans(text)
        return time.perf_counter() - at

    for unit in ("เปิดแล้วครับ ราคา บาทค่ะ ไม่มี จบ ", "x.y.", '"a" ', "( ", "ab. ", "AB CD. OF ", "word ", "[x "):
        small, large = min(took(unit * (50_000 // len(unit))) for _ in range(2)), took(unit * (1_000_000 // len(unit)))
        assert large < 60 * small + 0.5, unit


def test_sentence_ranges_are_ordered_and_tight(spark):
    rng = random.Random(4)
    bits = ["Dr. ", "A. ", '"', "(", ")", "word ", "! ", "? ", ".\n", "\n\n", "\n- ", "。", "「", "」", ":-) ", "1. ", "e.g. ", "x", " ", "É", "«", "»", "..."]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        at = 0
        for a, b in sentences.sentence_spans(t):
            assert at <= a < b and t[a:b] == t[a:b].strip() and not t[at:a].strip()
            at = b
        assert not t[at:].strip()
    df = spark.createDataFrame([(1, "Ab cd. Ef gh."), (2, None), (3, "x" * 200_000), (1, "Q.")], "doc_id long, text string").withColumn("start_pos", F.lit(9))
    assert sentences.split_sentences(df).count() == 4
