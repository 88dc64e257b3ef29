import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import abuse, leaks, mixing, pii, pii_forms, queries, residue, residue_forms, splits, textnorm

# ---------------------------------------------------------------- abuse
ABUSE = ["you are a worthless idiot", "y0u @r3 @ w0rthl3$$ 1d10t", "you are a w-o-r-t-h-l-e-s-s idiot", "yоu аrе а wоrthlеss idiоt", "I will smash your face", "send me your n*des", "du bist ein dummer Idiot", "vete al infierno, gilipollas", "ferme ta gueule, connard", "all refugees are disgusting parasites", "Frauen sind zu duuumm für sowas"]
HARMLESS = ["a colleague called me an idiot in the meeting, how do I report that", "kill the stuck process", "the damn printer is stuck again", "could you sort the price table", "breast cancer screening dates", "das ist ein schöner Tag", "la perra de mi vecina necesita vacuna", "", "   ", "12345"]


@pytest.fixture(scope="module")
def scorer():
    return abuse.Scorer(*abuse.model(tuple(["could you check the test plan for next week", "please print the weekly digest", "nous aimerions trier la liste", "bitte hilf mir die Liste zu öffnen", "necesito abrir la tabla"] * 20)))


def test_severity(scorer):
    cut = scorer.cutoff()
    assert [t for t in ABUSE if scorer.severities([t])[0] <= cut] == []
    assert [t for t in HARMLESS if scorer.severities([t])[0] > cut] == []
    assert scorer.severities([None])[0] == 0
    threat, insult = scorer.severities(["I will kill you and your family", "you idiot"])
    assert threat > insult


def test_long_text_is_read_to_its_end(scorer):
    assert scorer.severities(["please check the list. " * 5000 + "you are a worthless idiot"])[0] > scorer.cutoff()


def test_thresholds_are_ordered(scorer):
    assert scorer.thresholds == sorted(scorer.thresholds)


def test_p1_tables(messages):
    m = messages({"message_id": 1, "message_text": ABUSE[0]}, {"message_id": 1, "message_text": ABUSE[0]}, {"message_id": 2, "message_text": "hello"}, {"message_id": 3}, {"message_text": ABUSE[0]}, {"message_id": 4, "message_text": ABUSE[0]}, {"message_id": 4, "message_text": "hello again"}).withColumn("severity", F.lit(9.0))
    assert [r[0] for r in abuse.p1_found(m).collect()] == [1]
    assert abuse.p1_rates(m).first()["n_messages"] == 4
    assert abuse.p1_found(messages()).count() == 0


def test_no_training_sentence_is_taken_from_the_tables():
    """No sentence shares a run of four words with the texts that are scored."""
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no tables here")
    import duckdb

    runs = lambda t: {tuple(w[i : i + 4]) for w in [re.findall(r"[^\W_]+", textnorm.fold(t))] for i in range(len(w) - 3)}
    have = set().union(*[runs(s) for s, _ in abuse.training_rows()])
    for table, column in (("messages", "message_text"), ("message_records", "text")):
        for (text,) in duckdb.sql(f"SELECT DISTINCT {column} FROM '{folder}/{table}.parquet' WHERE {column} IS NOT NULL").fetchall():
            assert not have & runs(text), text


def test_wordings_kept_apart_are_found():
    got = abuse.held_out(parts=2)
    assert got["recall"] > 0.8, got


def test_words():
    w = textnorm.Words({"idiot": 1.0, "shit": 1.0})
    assert w("1d10t !d!ot id*ot idiiiiot $hit") == ["idiot", "idiot", "idiot", "idiot", "shit"]
    assert textnorm.join_spaced("an i d i o t here") == "an idiot here"


# ---------------------------------------------------------------- splits
def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(95)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("x", None), (None, None), ("s", "s")]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        elif a:
            find(a)
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: find(n) for n in root}


def test_pairs_and_splits(spark, messages):
    m = messages(*[{"message_id": i, "user_id": u} for i, u in enumerate(["u00-000001", "U00-1", "user:u00-000001", "u00-000001-b", "u00-2", None, " ", "odd", "weird"])], {"message_id": 7, "user_id": "odd"}, {"message_id": 8, "user_id": "odd"})
    assert {tuple(r) for r in splits.p3_found(m).collect()} == {("U00-1", "u00-000001"), ("U00-1", "user:u00-000001"), ("u00-000001", "user:u00-000001"), ("odd", "weird")}
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("none", None)], "split_name string, target_share double")
    out = splits.assign_splits(m.withColumn("split_name", F.lit("old")), t).select("message_id", "user_id", "split_name").collect()
    assert len(out) == 11
    assert len({r["split_name"] for r in out if r["user_id"] in ("u00-000001", "U00-1", "user:u00-000001")}) == 1
    assert {r["split_name"] for r in out} <= {"train", "test"}
    assert splits.p3_found(messages()).count() == 0
    assert splits.assign_splits(messages(), t).count() == 0


def test_a_component_stays_in_its_split_when_the_tables_grow(spark, messages):
    rows = [{"message_id": i, "user_id": f"u00-{i % 50}"} for i in range(200)]
    more = rows + [{"message_id": 1000 + i, "user_id": "u00-7" if i % 3 else f"u01-{i}"} for i in range(900)]
    t = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    before, after = [{r["user_id"]: r["split_name"] for r in splits.assign_splits(messages(*x), t).collect()} for x in (rows, more)]
    assert all(after[u] == s for u, s in before.items())


def test_shares_with_a_hot_account(spark, messages):
    m = messages(*[{"message_id": i, "user_id": "hot" if i % 3 == 0 else f"u00-{i}"} for i in range(1500)])
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = {r["split_name"]: r["count"] for r in splits.assign_splits(m, t, heavy_share=0.002).groupBy("split_name").count().collect()}
    assert abs(got["train"] / 1500 - 0.8) < 0.05
    assert abs(got["test"] / 1500 - 0.1) < 0.04


# ---------------------------------------------------------------- personal information
@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("write to anna.b@mail.example please", "email", "anna.b@mail.example"), ("cc tavo (at) box (dot) test now", "email", "tavo (at) box (dot) test"), ("ring +44 (0)20 7946 0872 and ask", "phone", "+44 (0)20 7946 0872"),
        ("call (303) 555-0149.", "phone", "(303) 555-0149"), ("SSN 934-26-1716", "id_number", "934-26-1716"), ("DNI 99954828-W.", "id_number", "99954828-W"), ("I live at 14 Juniper Hill Lane, Apt 3", "address", "14 Juniper Hill Lane"),
        ("vivo en C/ Tejedores 125, 3º B", "address", "C/ Tejedores 125"), ("wohne Am Alten Wehr 26a", "address", "Am Alten Wehr 26a"), ("to P.O. Box 33.", "address", "P.O. Box 33"), ("tell Ms. de la Trobe", "person", "de la Trobe"), ("this is Dr. Noémine O'Tierran speaking", "person", "Noémine O'Tierran"),
    ],
)
def test_forms(text, kind, value):
    got = [(c.kind, text[c.start : c.end]) for c in pii_forms.candidates(text) if c.seed]
    assert (kind, value) in got


@pytest.mark.parametrize("text", ["install toolkit@1.4.2 and retry", "use @property above", "row 12 of Main Street survey", "meet at Platz 14", "the query user@@domain", "the call lasted 01:01:43", "version 10.4.22", "order 4417-2093-11", "on 2024-03-17 at 14:30", ""])
def test_no_self_telling_form(text):
    assert [c for c in pii_forms.candidates(text) if c.seed] == []


def corpus(messages):
    rows = []
    names = ["Amadis Tregonnick", "Yolande Veldrane", "Sverre Ostrevin"]
    for i in range(30):
        n = names[i % 3]
        rows.append(f"tell Dr. {n} that I am late")
        rows.append(f"SSN 93{i % 10}-26-17{i:02d} was lost")
        rows.append(f"SSN 9342617{i:02d} was lost")
        rows.append("batch 204881937 passed the check")
        rows.append("New Year party in the Green Room")
        rows.append(f"{n} signed the form" if i % 2 else f"— {n.upper()}")
    return messages(*[{"message_id": i, "message_text": t} for i, t in enumerate(rows)], {"message_id": 900, "message_text": None}, {"message_id": 901, "message_text": ""}), rows


def test_corpus_decides(spark, messages, records):
    m, rows = corpus(messages)
    got = {(r["row_id"], r["kind"]) for r in pii.p5_found(m, records()).collect()}
    want = {(i, "person") for i, t in enumerate(rows) if t.startswith(("tell", "—")) or "signed" in t} | {(i, "id_number") for i, t in enumerate(rows) if t.startswith("SSN")}
    assert got == want
    clean = {r["message_id"]: r["message_text"] for r in pii.sanitise(m, "message_id", "message_text").collect()}
    assert clean[0] == "tell Dr. [PERSON] that I am late"
    assert clean[2] == "SSN [ID_NUMBER] was lost"
    assert clean[3] == rows[3]
    assert clean[900] is None
    assert len(clean) == len(rows) + 2
    assert pii.p5_found(messages(), records()).count() == 0


def test_number_that_begins_a_line(spark, messages, records):
    rows = [f"My mobile\n+44 20 7946 08{i:02d} works" for i in range(12)] + ["My mobile\n0151 496 0123", "0151 496 0124 works", "0151 496 0125", "The batch\n0151 496 0126"]
    m = messages(*[{"message_id": i, "message_text": t} for i, t in enumerate(rows)])
    assert {r["row_id"] for r in pii.p5_found(m, records()).where("kind = 'phone'").collect()} == set(range(14))


def test_both_tables_are_sanitised_as_one_corpus(spark, messages, records, tmp_path):
    m, _ = corpus(messages)
    r = records({"record_id": 1, "text": "SSN 934261799 was lost"}, {"record_id": 2, "text": "Yolande Veldrane signed the form"}, {"record_id": 3, "text": "batch 204881937 passed the check"}, {"record_id": 4})
    m.write.parquet(str(tmp_path / "messages.parquet"))
    r.write.parquet(str(tmp_path / "message_records.parquet"))
    out = queries.p5_sanitised(spark, str(tmp_path))
    got = {(x["record_set"], x["row_id"]): x["text"] for x in out.collect()}
    assert len(got) == m.count() + 4
    assert got["messages", 0] == "tell Dr. [PERSON] that I am late"
    assert got["message_records", 1] == "SSN [ID_NUMBER] was lost"  # disclosed by the messages alone
    assert got["message_records", 2] == "[PERSON] signed the form"
    assert got["message_records", 3] == "batch 204881937 passed the check"
    assert got["message_records", 4] is None
    found = {(x["record_set"], x["row_id"]) for x in pii.p5_found(m, r).collect()}
    assert found == {k for k, t in got.items() if t and "[" in t}


# ---------------------------------------------------------------- leaks
def make_items(n=12, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    shared = " ".join(word() for _ in range(25))
    return [(i, " ".join(word() for _ in range(60)) + (" " + shared if i % 2 else "")) for i in range(n)], shared, word


def test_leaks(spark):
    items, shared, word = make_items()
    noise = lambda n: " ".join(word() for _ in range(n))
    w = items[3][1].split()
    edited = [x for k, x in enumerate(w[5:45]) if k % 13 != 6]
    edited[4] = "maybe"
    docs = [
        (1, noise(50) + " " + " ".join(w[10:45]) + " " + noise(50)), (2, noise(30) + " " + " ".join(edited) + " " + noise(9)), (3, noise(40) + " " + " ".join(w[0:12]) + " " + noise(60)), (4, noise(60) + " " + shared + " " + noise(20)),
        (5, "<p>" + " ".join(f"<b>{x.upper()}</b>" if k % 4 == 0 else x[:2] + "­" + x[2:] for k, x in enumerate(w[:40])) + "</p>"), (6, None), (7, ""), (8, noise(8000) + " " + " ".join(w[:40])), (9, "> " + "\n> ".join(w[:40])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks.leaked(d, e).collect()} == {(k, 3) for k in (1, 2, 5, 8, 9)}
    assert leaks.leaked(d.limit(0), e).count() == 0
    assert leaks.leaked(d, e.limit(0)).count() == 0


def test_shared_text_is_found_across_blocks(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    shared = noise(45)
    items = [(0, f"{noise(50)} {shared}"), (1, noise(60)), (2, noise(60)), (3, f"{noise(50)} {shared}")]
    e = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, f"{noise(40)} {shared} {noise(40)}"), (2, f"{noise(9)} {items[1][1]} {noise(9)}"), (3, items[3][1])], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_PRINTS", 60)
    assert len(leaks.blocks_of(leaks.own_segments(items), 60)) > 1
    assert {tuple(r) for r in leaks.leaked(d, e).collect()} == {(2, 1), (3, 3)}


@pytest.mark.parametrize("table_bytes", [0, leaks.TABLE_BYTES])
def test_no_pair_within_the_radius_is_missed(table_bytes, monkeypatch):
    monkeypatch.setattr(leaks, "TABLE_BYTES", table_bytes)
    items, *_ = make_items(20)
    x = leaks.Index(items)
    rng = np.random.default_rng(0)
    base = x.fingerprints[rng.integers(0, len(x.fingerprints), 300)]
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 18), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in base])
    prints = base ^ flips
    rows, cols = x.near(prints)
    want = {(i, j) for i, p in enumerate(prints) for j, f in enumerate(x.fingerprints) if int(p ^ f).bit_count() <= leaks.RADIUS}
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) == want


def test_passages_with_edits_are_found():
    """Recall on passages of 30 words with three edits, spread as one in nine."""
    items, _, word = make_items(40, seed=9)
    index = leaks.Index(items)
    rng = random.Random(12)
    hit = total = 0
    for i, text in items:
        w = text.split()[:60]
        for _ in range(10):
            a = rng.randrange(31)
            passage = w[a : a + 30]
            for at in sorted(rng.sample(range(2, 28), 3), reverse=True):
                passage[at : at + 1] = {0: [], 1: [word()], 2: [passage[at], word()]}[rng.randrange(3)]
            total += 1
            hit += i in index.leaks([word() for _ in range(40)] + passage + [word() for _ in range(40)])
    assert hit / total > 0.97, hit / total


# ---------------------------------------------------------------- mixing
def sources(spark):
    rows = [(i, f"word{i} " * (5 + i % 7), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 120 + ["tiny"] * 6)]
    return spark.createDataFrame([*rows, (9001, None, "big"), (9002, "x", None), (9003, "", "mid"), (9004, "x", "other")], "doc_id long, text string, source string")


def test_mixture_reaches_its_shares(spark):
    t = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.05, 8), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sources(spark), t)
    got = {r["source"]: r for r in mixing.shares(mixed, t).collect()}
    for s, share in (("big", 0.6), ("mid", 0.3), ("tiny", 0.05)):
        assert got[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.01)
    assert got["absent"]["n_docs"] == 0
    copies = {(r["source"], r["doc_id"]): r["copies"] for r in mixed.collect()}
    assert 1 < max(c for (s, _), c in copies.items() if s == "tiny") <= 8
    assert max(c for (s, _), c in copies.items() if s == "big") == 1
    assert len(copies) == mixed.count()


def test_capped_source_gives_what_it_may(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sources(spark), t, total_tokens=4000)
    tiny = mixed.where("source = 'tiny'").collect()
    assert {r["copies"] for r in tiny} == {2}
    assert mixing.mixture(sources(spark).limit(0), t).count() == 0


def test_inclusion_follows_the_weights(spark):
    d = sources(spark).where("source = 'big'").withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = [r["doc_id"] for r in mixing.mixture(d, t, total_tokens=1500, weight="w").collect()]
    even = sum(i % 2 == 0 for i in got)
    assert even > 1.8 * (len(got) - even)


# ---------------------------------------------------------------- residue
@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ first_name }}, thank you.", "Dear [Your Company], hello", "We met on XX/XX/XXXX in town.", "The ${user} left.", "See %link% for more.", "Hello <first name>, welcome", "the __ticket_id__ stayed open", "a {0} of {1} b", "value undefined undefined here",
        "404 Not Found", "Access denied. Reference no. 12ab34cd", "Zugriff verweigert", "Page introuvable", "Error interno del servidor", "Ein interner Fehler ist aufgetreten.", "Please enable JavaScript to continue.", "J a v a S c r i p t is required", "Esta página necesita scripts para funcionar.",
        "Lorem ipsum dolor amet consectetur adipiscing elit tempor incididunt labore", "asdf jkl; asdf jkl; asdf jkl; asdf jkl; asdf jkl;", "Your text goes here.", "Text folgt.",
    ],
)
def test_residue(text):
    assert residue_forms.facts("The team met on Monday. " + text) or residue_forms.facts(text)


@pytest.mark.parametrize(
    "text",
    [
        "the interpolated string uses $name or ${name} in this shell", "printf takes %s for text", '```\nprint(f"hello {name}")\n```', "The <b>bold</b> part", "array[i] and list[3]", 'the record was {"user": 11, "active": true}', "the widget shows 404 Not Found since Monday",
        "die Fehlerseite 404 wurde neu gestaltet", "designers like lorem ipsum because nobody reads it", "cookies and scripts were the topic of the training", "access was denied to the intern", "the error budget for May is nearly spent", "she answered the todo list item by item", "",
    ],
)
def test_no_residue(text):
    assert residue_forms.facts(text) == []


@pytest.mark.parametrize("text", ["Hola (nombre), gracias.", "Termin am TT.MM.JJJJ", "Bonjour (nom)", "An «Name», hallo", "The page you are looking for has moved.", "Dear {{ " + "customer_" * 20 + "name }}, hi", "Dear [Your " + "very " * 20 + "Long Name], hi"])
def test_nothing_is_lost_before_the_patterns(text):
    assert residue_forms.facts(text)


def test_quick_filters_agree_with_the_patterns():
    """On whole texts and on each of their segments: what a pattern finds, its quick filter lets through."""
    folder = Path("/root/testdata/sf0.1")
    texts = ["".join(random.Random(i).choices("{}[]<>%$#@|_«»~*() \nXDTJM.-/abnul", k=60)) for i in range(3000)]
    if folder.exists():
        import duckdb

        texts += [t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' WHERE text IS NOT NULL USING SAMPLE 1500").fetchall()]
    for t in texts:
        for s in [t, *residue_forms.segments(t)]:
            low = textnorm.fold(s)
            assert not residue_forms.SLOT.search(s) or residue_forms._SLOT_QUICK.search(s), s
            assert not residue_forms.ERROR.search(low) or any(w in low for w in residue_forms._ERRORS) or residue_forms._CODES.search(low), s
            assert not residue_forms.FILLER.search(low) or any(w in low for w in residue_forms._FILLERS), s
            assert not residue_forms.NOTICE.search(low) or any(w in low for w in residue_forms._SCRIPTS), s


@pytest.mark.parametrize("copies", [3, 8, 1000])
def test_unfilled_greeting_is_found_however_often(spark, copies):
    d = spark.createDataFrame([(i, f"Note {i} of the day.\nDear {{{{first_name}}}}, your parcel is here.\nBye.") for i in range(copies)], "doc_id long, text string")
    assert residue.p8_found(d).count() == copies


def test_spoilt_documents(spark):
    rows = [(1, "Hello {name}, welcome."), (2, "All is well."), (3, None), (4, ""), (None, "404 Not Found"), (5, "x. " * 9000 + "Hello [Your Name], hi")]
    wording = [(100 + i, f"Place {i} is far. Write ⟦ [object Object] ⟧ on it as ever. Then walk {chr(97 + i)}{chr(98 + i)}.") for i in range(8)]
    d = spark.createDataFrame([*rows, *wording], "doc_id long, text string").withColumn("kind", F.lit("mine"))
    assert {r[0] for r in residue.p8_found(d).collect()} == {1, 5}
    assert residue.clean(d).count() == len(rows) + len(wording) - 2
    assert residue.p8_found(d.limit(0)).count() == 0


def test_boilerplate_counts_however_often_it_is_used(spark):
    rows = [(i, f"Item {chr(97 + i)} was sold. Contact us at [EMAIL] for help. Then came {chr(98 + i)}{chr(99 + i)}.") for i in range(20)]
    rows += [(100 + i, f"Part {chr(97 + i)}.\nTODO: write this section\nPart {chr(99 + i)}.") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in residue.p8_found(d).collect()} == {r[0] for r in rows}


def test_alignment_induces_slots(spark):
    names = ["Anna", "Bo", "Cleo Marsh", "Dora", "Emil", "Fee", "Gus", "Hedda"]
    rows = [(i, f"Note {chr(97 + i)}. The parcel for {n} was left at the gate. Bye {chr(98 + i)}.") for i, n in enumerate(names)]
    left = ["null", "first_name", '"{{first_name}}"', "( )"]
    rows += [(100 + i, f"Memo {chr(97 + i)}. The parcel for {v} was left at the gate.") for i, v in enumerate(left[:2] + left[3:])]
    rows += [(110, "Memo x. By the placeholder list, the parcel for {{first_name}} was left at the gate."), (200, "Hello {{first_name}}, hi.")]
    wording = [(300 + i, f"Part {chr(97 + i)}. The column holds null in old rows. Write \"{{{{name}}}}\" on it. Set first_name to be shown.") for i in range(9)]
    d = spark.createDataFrame([*rows, *wording, (400, None), (401, "")], "doc_id long, text string")
    assert {r[0] for r in residue.p8_found(d).collect()} == {100, 101, 102, 110, 200}
    assert residue.p8_found(d.where("doc_id IN (100, 101, 102, 110)")).count() == 0
    assert residue.clean(d).count() == d.count() - 5
