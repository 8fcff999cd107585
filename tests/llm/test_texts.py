"""Personal information, tokenizer, tiling and residue: held-out cases, round trips and brute force."""

import random
from re import _parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import bytepair as bp
from lantern.llm.pii import find_personal, lexicon, name_lexicon, plain, redacted, spans
from lantern.llm import residue as rs
from lantern.llm.residue import has_slot, judge, leaf_of, mask, merged, message_templates, residue, segments, verdict, words_of
from lantern.llm.tiling import Index, leaks, tiles, words

GIVEN, FAMILY = {"orvika", "senna"}, {"blenmark", "thorvest"}


def kinds(text):
    return [k for _, _, k in spans(text, GIVEN, FAMILY)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+c@mail.example.org now", ["email"]), ("a (at) b [dot] org", ["email"]), ("a.b AT host DOT net", ["email"]), ("x&#64;y.test", ["email"]), ('<a href="mailto:q@r.test">me</a>', ["email"]), ("ｑ＠ｒ.test", ["email"]),
        ("Rated 4.5 @ 46 votes", []), ("chat: @user_name", []), ("look at page 3 dot two", []),
        ("+44 20 7946 0958", ["phone"]), ("(020) 555-0187", ["phone"]), ("tel: 2025550143", ["phone"]), ("five five five oh one nine nine", ["phone"]), ("202.555.0143", ["phone"]), ("030/23125-111", ["phone"]), ("1-800-555-0199 x12", ["phone"]), ("by F. Hortano.</p><p>0044-1632-960190", ["phone"]), ("Elm Row\n030/23125-936", ["phone"]),
        ("Version 12.34.567.890", []), ("Ticket 555-21647", []), ("Order ORD-2020-117426", []), ("12 345 678 points", []), ("ISBN 978-3-16-148410-0", []), ("on 2019-03-14 05:22", []),
        ("SSN: 123-45-6789", ["id_number"]), ("passport no. X1234567", ["id_number"]), ("NI number QQ 12 34 56 C", ["id_number"]), ("tax id 12/345/67890", ["id_number"]), ("driver's licence ABCDØ123456X9Y", ["id_number"]), ("Licence: do what you like", []),
        ("12 Elm Street", ["street_address"]), ("Elmgasse 4/2", ["street_address"]), ("Calle Olmo 14, 3º B", ["street_address"]), ("14 rue du Chêne", ["street_address"]), ("Elm Road 7", ["street_address"]), ("20 Minutes Down Memory Lane", []), ("the 13 Alder Rules", []), ("Tower Street Software", []),
        ("Orvika Blenmark wrote it", ["person_name"]), ("ORVIKA BLENMARK", ["person_name"]), ("Thorvest, Senna", ["person_name"]), ("Ôrvika L. Thorvest", ["person_name"]), ("by Dr K. Unheard", ["person_name"]), ("My name is Some Body.", ["person_name"]), ("B. Blenmark here", ["person_name"]),
        ("the Blenmark-Thorvest test", []), ("Orvika Blenmark Systems", []), ("Blenmark Ltd", []), ("orvika.blenmark@mail.test", ["email"]),
        ("", []), (None, []), ("   ", []),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_spans_lie_in_the_source_and_the_rest_is_kept():
    text = "ｎｏｔｅ: <b>ring</b> five five five oh one nine nine &amp; x&#64;y.test, Orvika Blenmark!"
    found = spans(text, GIVEN, FAMILY)
    assert [text[a:b] for a, b, _ in found] == ["five five five oh one nine nine", "x&#64;y.test", "Orvika Blenmark"]
    assert redacted(text, found) == "ｎｏｔｅ: <b>ring</b> [PHONE] &amp; [EMAIL], [PERSON_NAME]!"
    assert plain("abc") == ("abc", None, None)
    assert plain("exаmple")[0] == "example"  # the third letter is Cyrillic


def test_long_texts_take_linear_time():
    for piece in ("a ", "1 ", "a@", "tin ", "a-", "(1) ", "five ", "<", "&amp;", "12 Elm ", "a dot ", "a at ", "[at] ", "a dot b at ", "Aa Lane "):
        spans(piece * 20000, GIVEN, FAMILY)


def test_lexicon_and_operator(spark):
    rows = [(1, "Orvika Blenmark", "by Orvika Blenmark", None), (2, "Orvika Thorvest", "", "12 Elm Street"), (3, "Senna Blenmark", None, "x"), (4, "Senna Thorvest", "x", "x"), (5, None, "x", "x"), (6, "user77", "x", "x"), (7, "One Off", "x", "x"), (None, None, "a@b.test", "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "user_id int, display_name string, about_me string, location string, text string")
    given, family = name_lexicon(df, "display_name")
    assert (given, family) == (GIVEN, FAMILY)
    got = {(r.user_id, r.field_name): (r.kinds, r.redacted) for r in find_personal(df, "user_id", ["about_me", "location"], given, family).collect()}
    assert got[1, "about_me"] == (["person_name"], "by [PERSON_NAME]") and (1, "location") not in got
    assert got[2, "location"] == (["street_address"], "[STREET_ADDRESS]") and got[2, "about_me"] == ([], "")
    assert len(got) == 12
    assert find_personal(df.limit(0), "user_id", ["about_me"], given, family).count() == 0


def test_own_and_rare_names(spark):
    rows = [(1, "Orvika Blenmark", "x"), (2, "Orvika Blenmark", "Ûlra Quenstal and Senna Thorvest"), (3, "Senna Thorvest", "x"), (4, "Senna Thorvest", None), (5, "Ûlra Quenstal", "I am Ulra Quenstal"), (5, "Ûlra Quenstal", "I am Ulra Quenstal"), (6, None, "by Ûlra Quenstal"), (7, "Orvika Blenmark", "Orvika Blenmark")]
    df = spark.createDataFrame(rows, "user_id int, display_name string, about_me string")
    # Repeats of a delivery are one user, whose own name is known in their own row only.
    given, family, rest = lexicon(df, "display_name", "user_id")
    assert (given, family, rest) == (GIVEN, FAMILY, None)
    found = lambda *x: {(r.user_id, r.redacted) for r in find_personal(df, "user_id", ["about_me"], *x).collect() if r.kinds}
    want = {(2, "Ûlra Quenstal and [PERSON_NAME]"), (5, "I am [PERSON_NAME]"), (7, "[PERSON_NAME]")}
    assert found(given, family, "display_name", rest) == want
    # Nothing changes when most of the lexicon is looked up by the join.
    for size in (0, 1):
        g, f, rest = lexicon(df, "display_name", "user_id", size=size)
        assert len(g) == len(f) == size and rest is not None
        assert found(g, f, "display_name", rest) == want


@pytest.fixture(scope="module")
def merges():
    pytest.importorskip("public_tokenizers")
    return bp.Merges(bp.load_ranks())


@pytest.fixture(scope="module")
def reference(merges):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("reference", pat_str=bp.PATTERN, mergeable_ranks=merges.ranks, special_tokens={}).encode_ordinary


POOL = "aaabcdeé  \t\n\n'sllre1234 ,.!?日本語🙂ßabab"


def test_encoding_equals_the_library_for_any_window(merges, reference, monkeypatch):
    rnd = random.Random(0)
    texts = ["", " ", "<|endoftext|>", "don't we'll I've", "a  b   \n\n c ", "x" * 3000, "日" * 700, " " * 999 + "x", "ab1" * 500] + ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(300))) for _ in range(120)]
    for window, step in ((1 << 16, 256), (16, 64), (5, 128)):
        monkeypatch.setattr(bp, "WINDOW", window)
        monkeypatch.setattr(bp, "STEP", step)
        merges._known.clear()
        for t in texts:
            want = reference(t)
            assert bp.encode(merges, t) == want, (window, t[:60])
            encoder, got = bp.Encoder(merges), []
            for i in range(0, len(t), 7):
                got += encoder.feed(t[i : i + 7])
            assert got + list(encoder.finish()) == want
            d = bp.Decoder(merges)
            assert "".join(d.feed([i]) for i in want) + d.finish() == t


def test_transducer_keeps_few_states(merges):
    machine = bp.Transducer(merges)
    most = 0
    for _ in range(400):
        list(machine.feed(b"abcab" * 20))
        most = max(most, len(machine.last))
    assert most < 4 * bp.STEP + 4 * merges.lookahead


def test_encode_and_decode_corpus(spark, merges, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, " \n"), (4, " \n"), (None, "x"), (5, "日本 🙂 " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, ids int")
    out = bp.encode_corpus(df, "doc_id", "text")
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r.doc_id or 0, r.ids) for r in out.collect()), key=str)
    assert got == sorted(((k or 0, reference(t) if t else []) for k, t in rows), key=str)
    back = {r.doc_id: r.text for r in bp.decode_corpus(out, "doc_id").collect()}
    assert back[5] == rows[-1][1] and back[2] == ""
    assert bp.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def brute_leaks(docs, items, k):
    grams = lambda t: {tuple(w[i : i + k]) for w in [words(t)] for i in range(len(w) - k + 1)}
    return {(d, i) for d, t in docs for i, s in items if t and s and grams(t) & grams(s)}


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{n}" for n in range(6)]
    items = [(n, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(2, 30)))) for n in range(25)]
    docs = []
    for n in range(120):
        text = " ".join(rnd.choice(vocabulary + ["x", "Y", "<b>z</b>"]) for _ in range(rnd.randrange(40)))
        if n % 3 == 0:
            source = items[rnd.randrange(25)][1].split()
            a = rnd.randrange(len(source))
            text += " — ".join(["", *source[a : a + rnd.randrange(1, 14)]]).upper() + " end"
        docs.append((n, text))
    docs += [(900, None), (901, ""), (902, "  "), (0, docs[0][1]), (None, items[0][1])]
    d = spark.createDataFrame([(*r, "q") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([*items, (77, None), (78, "")], "item_id int, item_text string")
    for block in (10**6, 300):
        got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "item_text", 5, block).collect()}
        assert got == brute_leaks([x for x in docs if x[0] is not None], items, 5)
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "item_text").count() == 0
    assert leaks(d, "doc_id", "text", i.limit(0), "item_id", "item_text").count() == 0


def test_words_and_tiles():
    assert words("<p>A-b_c 1½ É</p>x") == ["a", "b", "c", "1½", "é", "x"]
    index = Index([(1, "a b c d e f g h i j")], 3)
    seq, found = index.seeds("f g h i j z a b c d e")
    marked = tiles(found[0], 3)
    assert sorted(m[2] for m in marked) == [5, 5]  # both halves of a reordered item
    assert seq[5] == 0
    # A longer match takes the words of a shorter one, which is cut.
    assert [m[2] for m in tiles([(0, 0), (1, 1), (2, 2), (10, 1)], 3)] == [5]


@pytest.mark.parametrize(
    "text, want",
    [
        ("404 Not Found", True), ("<h1>Bad Gateway</h1>", True), ("Error 503: service unavailable. Please try again later.", True), ("You need to enable JavaScript to run this app.", True), ("Please turn on scripts in your browser!", True),
        ("Fehler 404. Seite nicht gefunden.", True), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("Your text here", True), ("foo bar foo bar", True), ("XXXX", True), ("Edit: No content yet", True),
        ("Dear {{ name }}, welcome.", True), ("Hello %FIRST_NAME%, hi", True), ("Posted by ${owner} today", True), ("Signed: __AUTHOR__", True), ("From <your name>", True), ("on &lt;question_date&gt;", True), ('Your question "{title}" was closed.', True), ("Seen [USER_NAME] there", True),
        ("Good answer. Fatal error: cannot load the rest of this post in view.tpl on line 7", True), ("First part.\n\n[Error loading content. Try again later]", True),
        ("The log has `404 Not Found` on 8 lines.", False), ('Users say the page shows "please enable JavaScript"; why?', False), ("I test with lorem ipsum, does it matter?", False), ("How do I escape `{{ name }}` in a template?", False), ("```\nDear {{ name }}\n```\nThis prints a name.", False),
        ("Use <b>bold</b> and x[[1]] in code.", False), ("Access to the table was denied last week, so I asked.", False), ("A plain sentence about sessions and pages.", False), ("Is $5 per kernel fair?", False), ("f(x) = {a}", False), ("[1] see [SOLVED]", False),
        ("", False), ("   \n", False),
    ],
)
def test_residue_of_one_text(text, want):
    masked = mask(text)
    marks = [verdict(" ".join(words_of(s))) for s in segments(masked)]
    assert (has_slot(masked) or bool(marks and (max(marks) == 2 or min(marks) == 1))) is want


def test_leaves_generalise_what_does_not_classify():
    one, two = (words_of(f"the archive mirror did not answer in {n} seconds {day}") for n, day in ((5, "today"), (9, "yesterday")))
    assert leaf_of(one) == leaf_of(two) and " ".join(merged(one, two)) == "the archive mirror did not answer in <*> seconds <*>"
    assert leaf_of(words_of("400 - bad request")) != leaf_of(words_of("502 - bad gateway"))
    assert leaf_of(words_of("somewhere in the deep archive i slept")) != leaf_of(words_of("somewhere in the deep archive we slept"))


def test_templates_do_not_depend_on_the_partitions(spark):
    texts = [f"the archive mirror did not answer in {n} seconds {d}" for n in range(20) for d in ("today", "yesterday", "tomorrow")] + ["404 Not Found", "Page 7 not found", "Insert title here", "your text goes here"] * 9 + [f"error {n} while loading page {w}" for n, w in enumerate("a b c d e f".split())]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = None
    for parts, batch in ((1, 10000), (3, 5), (8, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {tuple(r) for r in message_templates(df.repartition(parts), "text").collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = want or got
        assert got == want
    assert ("the archive mirror did not answer in <*> seconds <*>", 60, 60, 2) in want


def test_support_decides_where_the_wording_alone_does_not():
    assert [judge("the gateway returned <*>, retry in a minute.", n, alone) for n, alone in ((1, 1), (9, 0), (9, 5))] == [1, 1, 2]
    assert [judge("database backend error, session rejected", n, alone) for n, alone in ((1, 1), (9, 0), (9, 5))] == [0, 0, 2]
    assert judge("i reload the page on error", 9, 9) == 0 and judge("the kernel of the sample is skewed", 99, 99) == 0


# Not used to write the patterns; what is found of them is the figure in the README.
HELD_OUT = [
    "The file you requested was moved to another server.", "Error: could not retrieve the thread.", "We are experiencing technical difficulties. Check back shortly.", "This question was removed from the site for reasons of moderation.", "An error occurred while loading this comment.",
    "The operation was aborted because the server is overloaded.", "404. That's an error.", "Oh no! There's nothing here.", "Access to this resource is restricted.", "Your request could not be processed at this time.", "Internal error, reference 8812-77.", "Bad request: missing parameter id.",
    "The service is temporarily down, we'll be back soon.", "Zeitüberschreitung der Anforderung.", "Interner Fehler, bitte versuchen Sie es später erneut.", "Une erreur est survenue, veuillez réessayer.", "Ha ocurrido un error inesperado.", "Si è verificato un errore.", "Ocorreu um erro ao carregar a página.",
    "Произошла ошибка, попробуйте позже.", "This website uses JavaScript. Please activate it in your settings.", "Your browser has scripts disabled, so comments cannot be shown.", "Abilita JavaScript per continuare.", "Enter title here", "Body text", "Ut enim ad minim veniam, quis nostrud exercitation.",
    "Greetings [USERNAME], your badge [BADGE_NAME] awaits.", "Dear ${user}, ${message}", "{% block content %}{% endblock %}", "This is some placeholder copy, please replace it.",
]
CONTENT = [
    "How do I return a 404 from the view when the row is missing?", "I get error 500 when I load the page, any idea?", "The page cache is not found to be the bottleneck.", "You can enable the planner option in the settings.", "Please try again with a larger sample and report the variance.",
    "My answer was deleted by a moderator.", "The server is slow because the index is missing.", "We could not reproduce the estimate.", "JavaScript closures capture variables by reference.", "Type checking here is optional.", "Thanks, that solved the error.", "The request id column is unique.", "It works on my server.",
]


def test_wording_not_tuned_for():
    def case(text):
        masked = mask(text)
        marks = [judge(" ".join(words_of(s)), 5, 5) for s in segments(masked)]
        return has_slot(masked) or bool(marks and (max(marks) == 2 or min(marks) == 1))

    assert not any(map(case, CONTENT))
    assert sum(map(case, HELD_OUT)) >= 12


def test_residue_operator(spark):
    rows = [(1, "404 Not Found"), (2, "All is well with the frozen kernel."), (3, None), (4, ""), (5, "Dear {{name}}, hi"), (6, "404 Not Found"), (None, "404 Not Found"), (7, "word " * 100000 + "\n\nYour browser blocks script execution")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, key string")
    for block in (10**6, 1):
        got = {r.doc_id: r.why for r in residue(df, "doc_id", "text", block).collect()}
        assert got == {1: "message", 5: "slot", 6: "message", 7: "message"}
    assert residue(df.limit(0), "doc_id", "text").count() == 0
    counted = {r.template: r.n for r in message_templates(df, "text").where("verdict = 2").collect()}
    assert counted["<*> not found"] == 3


def sample(parts, rnd):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, x in parts:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "SUBPATTERN":
            out += sample(x[-1], rnd)
        elif op == "BRANCH":
            out += sample(rnd.choice(x[1]), rnd)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(x[2], rnd) for _ in range(rnd.randint(x[0], min(x[1], x[0] + 2))))
        elif op == "IN":
            o, c = rnd.choice(x)
            out += chr(c) if str(o) == "LITERAL" else {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "q", "CATEGORY_NOT_WORD": rnd.choice(" -,/'"), "CATEGORY_NOT_SPACE": "q"}[str(c)]
        elif op == "ANY":
            out += rnd.choice("q z,")
    return out


@pytest.mark.parametrize(
    "text",
    [
        "fehler 404: seite nicht gefunden", "errore 404: pagina non trovata", "fout 404 - pagina niet gevonden", "erro 403: acesso negado", "seite wurde nicht gefunden", "you do not have privileges for that", "you don't have the right to see this",
        "unhandled rejection in the view", "your description", "click here to edit it", "no description yet", "ha ha ha ha ha ha ha ha ha ha ha ha ha ha", "so so so so 1 2 3 4", "/ '",
    ],
)
def test_what_has_a_verdict_is_mined(text):
    assert verdict(" ".join(words_of(text))) > 0 and rs.may_classify(text)


def test_everything_with_a_verdict_is_mined():
    rnd, seen = random.Random(3), 0
    sources = [(p.pattern, 0) for p in (*rs._STRONG, *rs._WEAK, *rs._BROAD)] + [(rs._FILLER.pattern, _parser.SRE_FLAG_VERBOSE)]
    for source, flags in sources:
        parsed = _parser.parse(source, flags)
        for _ in range(600 if flags else 60):
            text = " ".join(sample(parsed, rnd).lower().replace("<*>", "7").split())
            seen += verdict(" ".join(words_of(text))) > 0
            assert rs.may_classify(text) or verdict(" ".join(words_of(text))) == 0, text
    assert seen > 1000
    # Also through what a template generalises.
    leaves, pool = {}, ["ha", "so", "q", "z", "8", "-", "the", "error", "/", "dolor", "js", "must"]
    texts = [" ".join(rnd.choice(pool[: rnd.randint(2, 12)]) for _ in range(rnd.randint(1, 12))) for _ in range(6000)]
    for t in texts:
        w = words_of(t)
        path = tuple(leaf_of(w))
        leaves[path] = merged(leaves.get(path, w), w)
    for t in texts:
        assert rs.may_classify(t) or not judge(" ".join(leaves[tuple(leaf_of(words_of(t)))]), 9, 9), t


def test_residue_in_ascii_of_other_languages(spark):
    df = spark.createDataFrame([(1, "Fehler 404: Seite nicht gefunden"), (2, "Erro 403: acesso negado"), (3, "All is well with the frozen kernel.")], "doc_id bigint, text string")
    assert {r.doc_id for r in residue(df, "doc_id", "text").collect()} == {1, 2}


def test_weak_messages_in_several_blocks(spark):
    rows = [(1, "Bad gateway. Please try again later."), (2, "Bad gateway. All is well with the kernel."), (3, "Please try again later. Oops! Bad gateway. Null."), (4, "Bad gateway. Nothing here works as I hoped."), (4, "All is well. Please try again later."), (5, "Oops! Oops! Oops!"), (6, "Dear {{name}}, hi")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {1: "message", 3: "message", 5: "message", 6: "slot"}
    for block in (10**6, 2, 1):
        assert {r.doc_id: r.why for r in residue(df, "doc_id", "text", block).collect()} == want, block


@pytest.mark.parametrize(
    "text, want",
    [
        ("jane@example dot org", "[EMAIL]"), ("jane AT example.org", "[EMAIL]"), ("jane dot doe at mail dot example dot org!", "[EMAIL]!"), ("j (dot) doe <at> mail [dot] co [dot] uk", "[EMAIL]"), ("reach me at jane dot doe at mail dot example dot org please", "reach me at [EMAIL] please"),
        ("call five five five double one two three four", "call [PHONE]"), ("call 555 one two three triple four", "call [PHONE]"), ("12 Kings Parade", "[STREET_ADDRESS]"), ("at 12 Old Mill Lane, Kalmirost", "at [STREET_ADDRESS], Kalmirost"), ("12 Old Mill Rd.", "[STREET_ADDRESS]"),
        ("20 Minutes Down Memory Lane", "20 Minutes Down Memory Lane"), ("look at example.org", "look at example.org"), ("I work at foo dot com", "I work at foo dot com"), ("meet at the dot on the i", "meet at the dot on the i"), ("one two three", "one two three"), ("rows two three four five", "rows two three four five"),
    ],
)
def test_disguises_are_written_plainly_with_their_spans(text, want):
    assert redacted(text, spans(text)) == want


_SCRAPS = st.sampled_from(["jane", " at ", " dot ", "[at]", "(dot)", "@", ".", "example", "org", "&#64;", "&lt;", "<p>", "<a href='mailto:x@y.zz'>", "​", "е", "ﬁ", "double ", "five ", "two ", "555-1234", "12 ", "Mill Lane", "Dr. ", "Ann ", "Lee", "\n", "ß", "🙂", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(_SCRAPS, max_size=24).map("".join))
def test_redaction_keeps_every_character_outside_its_spans(text):
    flat, start, end = plain(text)
    if start is not None:
        assert len(flat) == len(start) == len(end) and all(0 <= a < b <= len(text) for a, b in zip(start, end)) and start == sorted(start)
    found = spans(text, {"ann"}, {"lee"})
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
    out, at = redacted(text, found), 0
    for n, (a, b, kind) in enumerate(found):
        mark = f"[{kind.upper()}]"
        assert out.startswith(text[(found[n - 1][1] if n else 0) : a] + mark, at)
        at += a - (found[n - 1][1] if n else 0) + len(mark)
    assert out[at:] == text[(found[-1][1] if found else 0) :]


def test_ids_leave_in_parts(spark, merges, monkeypatch):
    texts = ["", None, "a b c d e f g h", "x", "long " * 50, "", "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    whole = {r.doc_id: r.ids for r in bp.encode_corpus(df, "doc_id", "text").collect()}
    monkeypatch.setattr(bp, "HELD_IDS", 3)
    assert {r.doc_id: r.ids for r in bp.encode_corpus(df, "doc_id", "text").collect()} == whole
    assert whole == {n: bp.encode(merges, t) for n, t in enumerate(texts)}


def test_index_of_items_is_compact():
    import pickle

    rnd = random.Random(4)
    vocabulary = [f"word{n}" for n in range(3000)]
    items = [(n, " ".join(rnd.choice(vocabulary) for _ in range(60))) for n in range(2000)]
    index = Index(items)
    assert len(pickle.dumps(index)) < 6 * sum(len(t) for _, t in items)
    text = items[7][1] + " and " + " ".join(items[9][1].split()[5:30])
    assert set(index.seeds(text)[1]) == {7, 9}
