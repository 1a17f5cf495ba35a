"""Encoding, leak search and residue rules, against the reference tokenizer, brute force and hand-made cases."""

import random

import numpy as np
from pathlib import Path

import pytest

from tideline.llm import bpe, leakage, residue

VOCABULARY = bpe.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def transducer():
    return bpe.Transducer.load(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "  two  spaces ", "hello world", "I'll don't we've", "naïve café — 12,345.67%", "日本語 текст عربي", "👩‍👩‍👧 ok", "<|endoftext|> x", "a\r\n\r\nb\t\tc", "a" * 3000, " " * 900, "-" * 500 + "x", "ab" * 2000, "\x00\x7f\x80", "x​y­z"]


@needs_vocabulary
def test_ids_equal_the_reference(transducer, reference):
    rng = random.Random(8)
    parts = ["a", "e", "th", "ing", "ion", " ", "  ", "\n", "é", "1", "23", "..", "qu", "中", "'s", "re", "XY", "_", "🙂"]
    for t in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]:
        assert transducer.encode(t) == reference.encode(t, add_special_tokens=False).ids, t


@needs_vocabulary
def test_tables_may_start_afresh(transducer, reference, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 50)
    small = bpe.Transducer.load(VOCABULARY)
    for t in TEXTS[:12]:
        assert small.encode(t) == reference.encode(t, add_special_tokens=False).ids


@needs_vocabulary
def test_long_pending_piece_is_merged_directly(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PENDING", 3)
    t = bpe.Transducer.load(VOCABULARY)
    for x in TEXTS:
        assert t.encode(x) == reference.encode(x, add_special_tokens=False).ids


@needs_vocabulary
def test_streaming_decode(transducer):
    for t in TEXTS:
        assert "".join(bpe.decode_stream(transducer, transducer.encode(t))) == t


def test_utf8_machine():
    rng = random.Random(2)
    for _ in range(400):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(rng.randrange(12)))
        m = bpe.Utf8Stream()
        assert "".join(m.feed(bytes([b])) for b in data) + m.end() == data.decode("utf-8", "replace")


@needs_vocabulary
def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hi there", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (1, "hi there", 1)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert len(got) == 5 and (2, []) in got and (3, []) in got and len(dict(got)[4]) > 0
    back = bpe.encode_corpus(df).select("doc_id", bpe.token_text("ids").alias("t")).collect()
    assert {(r.doc_id, r.t) for r in back} == {(1, "hi there"), (2, ""), (3, ""), (4, " \n")}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# --- Leaks --------------------------------------------------------------------


def test_words():
    assert leakage.words("<p>The <b>dep</b>ot​ of Café, 752,386&nbsp;pac-\nkaging 12 .5</p>") == ["the", "depot", "of", "cafe", "752386", "packaging", "125"]
    assert leakage.words(None) == leakage.words("  \n") == []


def edits_by_table(a, b):
    """Least edits to turn a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def best_by_table(a, b, e):
    return max((i for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or (j and a[i - 1] == b[j - 1] and edits_by_table(a[:i], b[:j]) <= e)), default=0)


def test_reach_against_tables():
    rng = random.Random(4)
    for _ in range(200):  # any words: never too much
        a, b = ([rng.randrange(1, 4) for _ in range(rng.randrange(8))] for _ in range(2))
        assert all(x <= best_by_table(a, b, e) for e, x in enumerate(leakage.reach(a, b, 3)))
    for _ in range(60):  # copies with sparse edits: exact
        a = [rng.randrange(1, 40) for _ in range(24)]
        b = []
        for k, w in enumerate(a):
            kind = rng.randrange(3) if k % 8 == 4 else 3
            b += {0: [99], 1: [], 2: [w, 98], 3: [w]}[kind]
        assert leakage.reach(a, b, 3) == [best_by_table(a, b, e) for e in range(4)]


def item(rng, n, tag):
    return [f"{tag}{rng.randrange(400)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(9)
    items = {i: item(rng, 50, "w") for i in range(1, 7)}
    filler = lambda n: [f"f{rng.randrange(300)}" for _ in range(n)]

    def altered(ws, every):
        out = []
        for k, w in enumerate(ws):
            kind = (k // every) % 3 if k % every == every // 2 else 3
            out += {0: ["zz"], 1: [], 2: [w, "extra"], 3: [w]}[kind]
        return out

    docs = {
        1: filler(30) + items[1] + filler(10),
        2: filler(5) + altered(items[2], 9) + filler(5),
        3: filler(5) + items[3][10:32] + filler(5),
        4: filler(5) + items[4][10:25] + filler(50),  # too short
        5: filler(5) + altered(items[5], 3) + filler(5),  # too many edits
        6: items[6][:25][::-1],  # wrong order
        7: ["<b>" + w.upper() + "</b>," for w in items[1][5:40]] + filler(3) + items[2][20:45],
    }
    rows = [(i, " ".join(ws), "en", 7) for i, ws in docs.items()] + [(8, None, "en", 7), (9, "", "en", 7), (10, " \n ", "en", 7), (11, " ".join(docs[1]), "en", 7), (None, " ".join(docs[1]), "en", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, item_id long")
    t = spark.createDataFrame([(i, " ".join(ws), 1) for i, ws in items.items()] + [(90, None, 1), (91, "", 1), (92, "too short", 1)], "item_id long, text string, doc_id long")
    for words in (60_000, 120):
        got = {(r.doc_id, r.item_id): r for r in leakage.leaked(d, t, block_words=words).collect()}
        assert set(got) == {(1, 1), (2, 2), (3, 3), (7, 1), (7, 2), (11, 1)}
    assert got[1, 1].stretch_words == 50 and got[1, 1].edits == 0 and got[3, 3].verbatim_words == 22
    assert {r[0] for r in leakage.without_leaks(d, leakage.leaked(d, t)).select("doc_id").collect()} == {4, 5, 6, 8, 9, 10, None}
    assert leakage.leaked(d.limit(0), t).count() == 0 and leakage.leaked(d, t.limit(0)).count() == 0


def test_an_item_longer_than_a_block(spark):
    long = [f"k{n}" for n in range(70_000)]
    other = [f"o{n}" for n in range(30)]
    docs = {
        1: ["x", *long[66_000:66_040], "x"],
        2: long[100:112] + ["zz"] + long[113:130],
        3: [long[65_535 + k] if k % 2 else long[k] for k in range(40)],  # equal only in 16 bits
        4: ["y", *other],
        5: long[40:59],
        6: long[59_980:60_030],
    }
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(7, " ".join(other)), (8, " ".join(long)), (9, " ".join(other))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.stretch_words, r.edits) for r in leakage.leaked(d, t).collect()}
    assert got == {(1, 8): (40, 0), (2, 8): (30, 1), (4, 7): (30, 0), (4, 9): (30, 0), (6, 8): (50, 0)}


def test_shard_search_against_brute_force(monkeypatch):
    """Stretches, verbatim lengths and places, with phrases that many items and documents share."""
    rng = random.Random(1)
    for _ in range(25):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 8, 40]))]
        items = [(k, [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]) for k in range(4)]
        docs = []
        for _ in range(6):
            x = []
            for _ in range(4):
                ws = rng.choice(items)[1]
                a = rng.randint(0, len(ws))
                x += ws[a : a + rng.randint(0, 40)] + [rng.choice([*vocabulary, "u1", "u2"]) for _ in range(rng.randint(0, 6))]
            docs.append(x)
        monkeypatch.setattr(leakage, "HITS", rng.choice([3, 50, 2_000_000]))
        block = leakage.make_block(items)
        ids = [np.array([leakage.word_id(w) for w in x], np.int64) for x in docs]
        got = {}
        for r in leakage.search_shard(list(range(6)), ids, block):
            got[r[:2]] = max(r, got.get(r[:2], r), key=lambda r: (r[3], -r[4], r[2]))
        for d, x in enumerate(docs):
            t = block.numbers(ids[d]).tolist()
            for k, (i, ws) in enumerate(items):
                s, best = block.seqs[k].tolist(), (0, 0)
                for p in range(len(s)):
                    for q in range(len(t)):
                        m = 0
                        while p + m < len(s) and q + m < len(t) and s[p + m] == t[q + m]:
                            m += 1
                        if m >= leakage.SEED:
                            best = max(best, leakage.grown(s, t, p, q, m), key=lambda z: (z[0], -z[1]))
                if best[0] < leakage.LEAST:
                    assert (d, i) not in got
                    continue
                _, _, verbatim, stretch, edits, dw, iw = got.pop((d, i))
                assert (stretch, edits) == best and x[dw : dw + verbatim] == ws[iw : iw + verbatim]
        assert not got


def test_many_items_read_the_corpus_once(spark):
    items = spark.range(10_000).selectExpr("id item_id", "array_join(transform(sequence(0, 49), k -> concat('w', id * 50 + k)), ' ') text")
    docs = spark.range(40).selectExpr("id doc_id", "concat('x y ', array_join(transform(sequence(5, 39), k -> concat('w', id * 250 * 50 + k)), ' ')) text")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    found = leakage.leaked(docs.mapInPandas(seen, "doc_id long, text string"), items)
    got = {(r.doc_id, r.item_id, r.verbatim_words, r.doc_word, r.item_word) for r in found.collect()}
    assert got == {(i, i * 250, 35, 2, 5) for i in range(40)}
    assert read.value == 40


def test_no_stretch_is_missed_by_the_seed():
    """Any 20 or more words with at most one edit in eight keep a verbatim run of the seed's length."""
    for n in range(20, 400):
        e = n // 8
        assert -(-(n - e) // (e + 1)) >= leakage.SEED


# --- Residue ------------------------------------------------------------------

RESIDUE = [
    "Shares of {{ ticker }} rose 3% on Monday.",
    "Volume reached ${volume} shares, broad for a Monday.",
    "The company, [INSERT NAME], will split the shares. Nothing else changed.",
    "El banco central de [SU CITY AQUÍ] dejó la tasa en 4%.",
    "Spreads in %(ticker)s widened to 5 ticks.",
    "Un martes #REF! dejó a KRJTN 5 pulsos sobre DJXE.",
    "Options on undefined expiring in May trade at 12.",
    "Lorem ipsum dolor sit amet.\nLorem ipsum dolor.",
    "TODO write the summary TODO write the summary",
    "xxxxx xxxx xxxxxx xxx",
    "[body] [body] [body] Check figures later.",
    "404 Not Found\n© 2020 Some Bank req-12345678",
    "<html><head><title>Some Bank</title></head><body><p>Error 503: Estamos en mantenimiento, vuelva más tarde</p><hr>© 2019 X 811af1c8</body></html>",
    'Home | Terms | Help\n{"error": {"status": 404, "title": "Gone", "detail": "nothing here"}}',
    "Too Many Requests!\nTraceback (most recent call last):\n  File \"x.py\", line 3\nXError: rate limit exceeded, slow down",
    "Please enable JavaScript to view this page.",
    "<html><head><title>{{headline}} - News</title></head><body><p>Halt lifted at 14:21.</p></body></html>",
    "<noscript>Veuillez activer JavaScript pour afficher cette page!</noscript>",
]
CONTENT = [
    "An alert of May 5, 2012 went out with the token ${dividend} still in it; two analysts had it reissued.",
    "See [8] and <desk@desk.example.invalid> for details; values marked NaN are missing.",
    "Clients of Some Bank saw error 404 (Page not found) for 22 minutes at the open, the treasurer said.",
    'The vendor now requires JavaScript on its portal, and the note reading "Please enable JavaScript to view this page" irked the treasurer.',
    "Filler stocks, placeholder bids and template orders were netted out by the auditor.",
    "Halt lifted at 14:21; first print 292.88, 7 lots.\nEnable JavaScript to see the interactive chart.",
    "Spreads in KRJTN widened. Our page not found? Write to the help desk.",
    '{"symbol": "XLZY", "open_ticks": 1, "state": null, "reasons": []}',
    "sym\ttime\tlast\nAAA\t09:51\tnull",
    "Pairs traded: {DQJE, BBXL}; weights [8, 8], coverage 100%.",
    "None of the banks moved its rate.",
    "", "  \n", None,
]


def test_residue_cases(spark):
    rows = [(i, t, f"src{i % 4}", "en", 0) for i, t in enumerate([*RESIDUE, *CONTENT])] + [(None, RESIDUE[0], "x", "en", 0), (500, RESIDUE[9], None, "en", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, hash long")
    found = residue.residue_documents(d)
    assert {r.doc_id for r in found.collect()} == {*range(len(RESIDUE)), 500}
    assert residue.without_residue(d, found).where("doc_id is not null").count() == len(CONTENT)
    assert residue.residue_documents(d.limit(0)).count() == 0


def test_unknown_companion_must_recur(spark):
    rows = [(i, f"502 Bad Gateway\nThe frobnicator check {i} has unexpectedly tripped", f"s{i}") for i in range(5)]
    rows += [(10, "502 Bad Gateway\nA check of the ledger was done once", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(d).collect()} == {0, 1, 2, 3, 4}


def test_any_number_of_unknown_companions(spark):
    page = "\n".join(["502 Bad Gateway", *(f"Line {w} of the site's own" for w in "one two three four five six seven eight nine ten".split())])
    short = "404 Not Found\nLine ten of the site's own"
    rows = [(i, page, f"s{i}") for i in range(4)] + [(10, short, "s1"), (11, page + "\nA word of news.", "s2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(d).collect()} == {0, 1, 2, 3, 10}


def test_messages_without_a_trigger_word(spark):
    """Every sentence is classified and may recur, whatever words it has."""
    texts = ["404 Not Found\nIt may have been deleted.", "Algo salió mal", "El artículo no está disponible", "The host timed out", "Resumen pendiente"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rows += [(10 + i, f"502 Bad Gateway\nKindly ring our bureau {i}.", f"s{i}") for i in range(4)]
    rows += [(20, "502 Bad Gateway\nThe bank held its rate.", "s0"), (21, "The bank held its rate.", "s1"), (22, "The host timed out\na\tb\tc", "s2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(d).collect()} == {0, 1, 2, 3, 4, 10, 11, 12, 13}


def test_hints_lose_no_rule():
    """What the placeholder and filler rules accept passes the cheap tests that come first."""
    forms = ["{{a}}", "{{ a|b('c') }}", "{% a %}", "<%= a %>", "[% a %]", "[[a]]", "<<a>>", "((a))", "${a}", "#{a}", "@{a}", "%{a}", "$(a)", "$[a]", "*|A|*", "@@a@@", "%%a%%", "##a##", "$$a$$", "~~a~~", "||a||", "::a::", "!!a!!", "^^a^^", "++a++",
             "#ABC#", "%ABC%", "$ABC$", "@ABC@", "~ABC~", "^ABC^", "%(a)s", "%s", "%1$s", "%.2f", "__a_b__", "{0}", "{name}", "<TICKER>", "<company_name>", "(company_name)", "(companyName)", "$company_name", "COMPANY_NAME", "<insert city>", "(insert city)", "[insert city]",
             "[city here]", "[Su City aquí]", "[à compléter : x]", "[votre nom]", "[company_name]", "[COMPANY NAME]", "[Company Name]", "« ISSUER »", "[tbd]", "(TBC)", "[●]", "____", "XX.X", "$XX", "XX million", "DD/MM/YYYY", "JJ/MM/AAAA", "YYYY-MM-DD",
             "undefined", "null", "NaN", "NaT", "None", "N/A", "#REF!", "#N/A", "#ERROR!", "#####", "[object Object]", "Invalid Date", "<NA>", "(null)"]
    for form in forms:
        for s in (f"Shares of {form} rose by noon.", f"{form} rose", f"Está en {form}.", form.upper() if form.isalpha() else form):
            assert residue.classify(residue.mask(s)) == "placeholder", s
    for s in ("xxxx xxxx test", "bla blah add facts", "headline to come, body copy here", "asdf hjkl", "todo fill in the body", "[body] more to come"):
        assert residue.classify(s) == "residue", s
        assert any(h in s for h in residue.RUN_HINTS)


def _site(unknown: str, n: int, start: int = 0, k: int = 5) -> list[tuple[int, str, str]]:
    """Documents of a site: an unknown message of 20 kinds of filler case, some with known furniture."""
    tails = ("", "\n© 2020 Some Bank req-12345678", "\nHome | Terms | Help", "!", "...")
    return [(start + i, f"{unknown}{tails[i % 5]}\n" + "\n" * (i % 3) + ("Home | Help | Terms" if i % 2 else ""), f"s{i % k}") for i in range(n)]


def test_unknown_message_that_stands_alone(spark):
    """No rule knows the words; that it recurs alone, in different texts, decides."""
    site = "Kindly await the gatekeeper's nod before you proceed"
    news = [(100 + i, f"The bank held its rate.\nA clerk from ward{'abcdefghijkl'[i]} counted crates.", f"s{i % 5}") for i in range(12)]
    alone = [(200, "The bank held its rate.", "s1")]
    copies = [(300 + i, "A tender lapsed on Monday.\nTwo mills shut.", f"s{i % 5}") for i in range(40)]
    rows = _site(site, 20) + news + alone + copies + [(400, site + "\nA clerk lost a ledger.", "s3"), (401, site + "\na\tb\tc", "s3")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert residue.classify(residue.mask(site)) == "content"
    got = {r.doc_id: r.reason for r in residue.residue_documents(d).collect()}
    assert got == dict.fromkeys(range(20), "recurring")


def test_unknown_furniture(spark):
    """A line that no rule knows and that keeps to the edges counts as furniture."""
    line = "Kept by the night desk of ours"
    news = [(100 + i, f"A clerk from ward{'abcdefghijklmnopqrst'[i]} counted crates.\n{line}", f"s{i % 5}") for i in range(20)]
    rows = [(0, f"404 Not Found\n{line}", "s1"), (1, f"Lorem ipsum dolor.\n{line}", "s2"), (2, line, "s3")]
    d = spark.createDataFrame(rows + news, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(d).collect()} == {0, 1}


def test_hot_message_is_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(residue, "HOT", 4)
    rows = [(i, "404 Not Found", f"s{i % 4}") for i in range(60)] + [(100 + i, f"Ward {'abcdefgh'[i]} shut\nXX.X million", "s") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert residue.residue_documents(d).count() == 68


def test_mask():
    assert residue.mask("On 12.05.2020 at 10:30 see https://a.b/c req-12345678 a1b2c3d4e5 x@y.zz") == "On 0 at 0 see address 0 0 address"


def test_mask_of_named_dates():
    for t in ("12 March 2024", "March 12, 2024", "Tuesday, 12 March 2024", "3 de mayo de 2020", "domingo 3 de mayo", "le 1er mars 2021".removeprefix("le "), "dimanche 14 juillet 2019", "May 5th, 2012", "Mon 5 Feb 2024", "12-Mar-2024", "March 2024", "Friday 7", "3 août 2020"):
        assert residue.mask(f"Checked on {t} by us") == "Checked on 0 by us", t
    for t, want in (("Unit 7 may fail on Monday.", "Unit 0 may fail on Monday."), ("In March 7 banks", "In 0 banks"), ("The march of a sun", "The march of a sun"), ("12 marches", "0 marches")):
        assert residue.mask(t) == want


def test_companion_with_a_named_date_recurs(spark):
    months = ["January", "February", "March", "April"]
    rows = [(k, f"502 Bad Gateway\nThe ledger was shut on {k + 3} {m} 2024 at noon", f"s{k}") for k, m in enumerate(months)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(d).collect()} == {0, 1, 2, 3}
