import random

import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import pairs as P

PROMPT = "The cache for late_map reads one file per hour. How do I keep route_id unique in late_map when the nightly export replays the totals?"


@pytest.mark.parametrize("text", [None, "", " ", "\t \r\n", "\xa0", "​​", "...", "-", "“”", '""', "{}", "**  **", "<p></p>", "```sql\n\n```", "null", "N/A", "n/a", "None"])
def test_empty(text):
    assert P.is_empty(text) and P.defect(PROMPT, text, False) == "empty"


@pytest.mark.parametrize("text", ["0", "No", "Yes", "42", "True", "Done ✅", "👍", "`a_b`", "ok"])
def test_short_answers_are_sound(text):
    assert P.defect(PROMPT, text, False) is None


@pytest.mark.parametrize(
    "text, refused",
    [
        ("I'm sorry, but I can't help with that request.", True),
        ("I’m unable to assist with this topic. Please contact the owner of the data instead.", True),
        ("Leider muss ich ablehnen, weil es den Richtlinien widerspricht.", True),
        ("Malheureusement, il m'est impossible de fournir cela.", True),
        ("Lo siento, pero no puedo ayudar con esa solicitud. Consulta con la persona responsable de la tabla.", True),
        ("I can't see a reason against it. The export reads one file.", False),
        ("I'm sorry to hear about vacuum-ops. Check whether the join reads a copy.", False),
        ("The line 'I cannot help with that' in the log came from vacuum-lake.", False),
        ("I can't share the rows, but here is the schema. The table has four columns.", False),
        ("Unfortunately, late_map is large. The export reads one file.", False),
    ],
)
def test_refusal(text, refused):
    assert P.is_refusal(text) is refused


@pytest.mark.parametrize("text", ["<div><p>" * 500 + "null" + "</p></div>" * 500, " \n" * 3000 + "N/A" + " " * 3000, "<p>" * 900, f'<div style="{"color: red; " * 300}"></div>', f"<!-- {'note ' * 400}--> none", "- " * 2000])
def test_long_empty(text):
    assert P.is_empty(text) and P.defect(PROMPT, text, False) == "empty"


@pytest.mark.parametrize("text", ["0" + " " * 5000, "<p>" * 900 + "No", f"<{'the rows are read ' * 40}>", "null " * 200 + "rows"])
def test_long_answers_are_not_empty(text):
    assert not P.is_empty(text)


def test_long_refusals():
    """Several thousand characters that only refuse are a refusal; an answer at their end makes them none."""
    grounds = "Unfortunately, it would expose confidential data. I must decline this request. Please contact the owner of the table. " * 60
    text = "I'm sorry, but I can't help with that request. " + grounds
    assert len(text) > 6000 and P.is_refusal(text) and P.defect(PROMPT, text, False) == "refusal"
    assert not P.is_refusal(text + "The export reads one file.")
    assert not P.is_refusal("The export reads one file. " * 300 + "I cannot help with that.")


@pytest.mark.parametrize(
    "text, copied",
    [
        (PROMPT, True), (PROMPT.upper(), True), ("> " + PROMPT, True), (f'"{PROMPT}"', True), ("You asked: " + PROMPT, True), (PROMPT[:-1], True),
        ("How do I keep route_id unique in late_map when the nightly export replays the totals?", True), (PROMPT + "\n\n" + PROMPT, True),
        (PROMPT + "\n\nAdd a unique key on route_id and drop the older rows before the merge.", False),
        ("`late_map`", False), ("late_map", False), ("Add a unique key on route_id in late_map.", False), ("", False),
    ],
)
def test_copy(text, copied):
    assert P.is_copy(PROMPT, text) is copied


@pytest.mark.parametrize(
    "prompt, text",
    [
        ("顧客テーブルの行が毎晩二重に書き込まれるのはなぜですか。理由を説明してください。", "顧客テーブルの行が毎晩二重に書き込まれるのはなぜですか。"),
        (PROMPT, PROMPT.replace(" ", "/")), (PROMPT, PROMPT.replace(" ", "_")), (PROMPT, " - ".join(PROMPT.split())), (PROMPT, ";".join(PROMPT.split()[10:])),
        (PROMPT, "".join(PROMPT.split())), ("Why so slow?", "Why so slow?"), ("Was heißt „späte Karte“ — œuvre?", "WAS HEISST SPÄTE KARTE ŒUVRE"),
    ],
)
def test_copies_in_another_dress_come_to_the_automaton(prompt, text):
    assert P.is_copy(prompt, text)


@pytest.mark.parametrize("text", ["late_map/route_id/nightly/export", "route_id unique", "The nightly export"])
def test_names_picked_from_the_prompt_are_answers(text):
    assert not P.is_copy(PROMPT, text)


@settings(max_examples=200, deadline=None)
@given(st.text(), st.sampled_from(["cache é ß œ’“–_ 1²", "ſ ŉ İ", "", "żółć", "日本"]))
def test_letters_are_letters_and_digits(text, more):
    assert P.letters(text + more) == P.ALNUM.sub("", (text + more).casefold())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_no_copy_is_kept_from_the_automaton(seed):
    """What `covered` finds to be a copy is_copy finds too, for random pairs of a small alphabet."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    prompt = word(60)
    response = word(rng.randrange(12)) + prompt[rng.randrange(20) :] + prompt[: rng.randrange(30)] + word(rng.randrange(4))
    p, r = P.letters(prompt), P.letters(response)
    if len(r) >= 8 and p and not (len(response.split()) < 4 and 2 * len(r) < len(p)):
        after, before, n = P.covered(p, r, min(12, len(r)))
        assert P.is_copy(prompt, response) is (before <= min(30, n // 2) and after <= max(2, 0.03 * n))


@pytest.mark.parametrize(
    "text",
    [
        "I won't help with this one.", "No can do, I'm afraid. I won't provide that.", "I cannot discuss the contents of that table.", "Sorry, I can't be of assistance here.", "I cannot fulfill this request.",
        "Das kann ich leider nicht beantworten.", "Dazu kann ich nichts sagen.", "Ich verweigere die Auskunft.", "Dieser Bitte kann ich nicht nachkommen.", "Hier kann ich nicht weiterhelfen.",
        "Je ne saurais répondre à cette demande.", "Je regrette, mais je ne répondrai pas à cela.", "Je décline cette demande.", "Désolé, je suis incapable de fournir ces données.",
        "No voy a responder a eso.", "Lo siento, no puedo cumplir con esa petición.", "Tengo que negarme.", "No puedo compartir esos datos.",
    ],
)
def test_refusals_in_other_words(text):
    assert P.defect("Why is the table slow?", text, False) == "refusal"


@pytest.mark.parametrize("text", ["No voy a negar que es lento: la tabla no tiene índice.", "Je ne vais pas plus loin que trois fichiers : le cache en lit un.", "Ich kann keine Dubletten sehen, der Schlüssel ist eindeutig. Die Abfrage liest eine Datei.", "I can't find null rows. The column is complete."])
def test_answers_that_begin_like_refusals(text):
    assert not P.is_refusal(text)


def test_repeating_on_request_is_sound():
    assert P.defect("Repeat exactly this line and nothing else:\nThe cache reads one file per hour.", "The cache reads one file per hour.", False) is None


EN = "The nightly export reads all of the rows that have no key, because the table was not closed."
DE = "Der Export liest alle Zeilen, die keinen Schlüssel haben, weil die Tabelle nicht geschlossen wurde."
IT = "Ogni partizione della tabella deve aspettare prima che il processo sia chiuso, se non ci sono dati."


@pytest.mark.parametrize(
    "prompt, response, found",
    [
        ("Why is the table slow?", DE, "language"), ("Warum ist die Tabelle so langsam?", DE, None), ("Why is the table slow?", IT, "language"),
        ("Answer in German, please. Why is the table slow?", DE, None), ("Answer in German, please. Why is the table slow?", EN, "language"),
        ("Translate the following note into French:\nThe table is closed.", EN, "language"), ("Réponds en allemand : pourquoi ?", DE, None),
        ("a_b schema", DE, None), ("Why is the table slow?", "```sql\nSELECT der, die FROM das\n```", None), (None, DE, None), ("[not logged]", DE, None),
        ("Why?", "[not logged]", None),
    ],
)
def test_language(prompt, response, found):
    assert P.defect(prompt, response, False) == found


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in "ab")
        want = [max((k for k in range(i + 2) if b[i + 1 - k : i + 1] in a), default=0) for i in range(len(b))]
        assert P.SuffixAutomaton(a).statistics(b) == want


@settings(max_examples=150, deadline=None)
@given(st.none() | st.text(), st.none() | st.text(), st.booleans())
def test_never_crashes(prompt, response, cut):
    assert P.defect(prompt, response, cut) in (None, "empty", "truncated", "refusal", "copy", "language")


def test_table(spark, sf):
    rows = [(1, "s", PROMPT, "", 1), (1, "s", PROMPT, "", 1), (2, None, PROMPT, PROMPT, 1), (None, "s", PROMPT, "", 1), (3, "s", None, None, 1), (4, "s", PROMPT, EN, 1), (5, "s", "x" * 200_000, "y " * 50_000, 1)]
    df = spark.createDataFrame(rows, "call_id long, source string, prompt string, response string, defect int")
    assert {(r.call_id, r.defect) for r in P.with_defects(df).collect()} == {(1, "empty"), (2, "copy"), (3, "empty"), (4, None), (5, None)}
    assert P.with_defects(df.limit(0)).count() == 0
    found = P.p1_found(spark, sf)
    assert found.columns == ["call_id", "defect"] and found.select("call_id").distinct().count() == found.count()
    assert sum(r.calls for r in P.p1_defects_by_source(spark, sf).collect()) == spark.read.parquet(f"{sf}/llm_calls.parquet").select("call_id").distinct().count()
