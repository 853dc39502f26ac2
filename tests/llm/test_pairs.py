"""Pair defects: forms, limits between them, and the operator on odd inputs."""

import random

import pytest

from weftline.llm import pairs as P

ASK = "Which rules cover CWE-89 in python code?"


@pytest.mark.parametrize("output", [None, "", " \r\n", "\ufeff", "\u2060\u200b", "\u00a0", "```\n```", "```json\n```", "{}", '""', "...", "-", "null", "None", "N/A", "n/a", "<no output>", "<br/>", "**", "#", "- ", "(empty)", "[]"])
def test_empty(output):
    assert P.defect_of(ASK, output) == "empty"


@pytest.mark.parametrize(
    "output",
    [ASK, ASK.upper(), ASK.lower()[:-1], f"**{ASK}**", f'"{ASK}"', "Which  rules cover  CWE-89 in python code ...?", f"{ASK}\n{ASK}", f"Instruction:\n{ASK}", f"Question: {ASK}"],
)
def test_echo(output):
    assert P.defect_of(ASK, output) == "echo"


def test_echo_of_a_long_prompt_without_its_context():
    assert P.defect_of(f"{ASK}\n\nRun: 4c6b60a018250a4f", ASK) == "echo"


@pytest.mark.parametrize("output", [f"{ASK}\n\nPY-SQLI-101 and PY-SQLI-204 cover it in python.", "CWE-89", "PY-SQLI-101, PY-SQLI-204", "- PY-SQLI-101\n- PY-SQLI-204", "See `a/b.py`.", "Yes.", "No, it does not apply to go.", "4 findings."])
def test_brief_and_quoting_answers_are_sound(output):
    assert P.defect_of(ASK, output) is None


@pytest.mark.parametrize(
    "output",
    [
        "I'm sorry, but I can't help with that request.", "As an AI assistant, I am not able to analyse security findings.", "No answer to this will come from me.", "Unfortunately this goes against my guidelines, so no answer can be given.",
        "To be clear, I can neither confirm nor discuss anything about RULE-1.", "Doing that is something I will not take part in.", "Hmm, helping with a patch is outside of what I may do.", "Je préfère ne rien dire de CI-XSS-101.",
        "Das lehne ich ab, denn die Angaben könnten missbraucht werden.", "Zu PY-CRYPTO-101 gebe ich keine Auskunft.", "Mis normas me impiden abrir a/b.py.", "Prefiro não abrir a/b.py.", "Mi dispiace, ma non posso rispondere.", "I\u2019d rather not discuss this.",
    ],
)
def test_refusal(output):
    assert P.defect_of(ASK, output) == "refusal"


@pytest.mark.parametrize(
    "output",
    [
        "The scanner refuses to follow symbolic links by design, which is why a/b.py does not appear in the report.", "The service declines requests without a session, so the guard is already there.",
        "You cannot suppress RS-XSS-101 globally; add an entry for a/b.py with an expiry date instead.", "Sorry for the confusion earlier: the finding belongs to a/b.py.", "Unfortunately the patch in 1.2.3 is incomplete. Apply the check to the other callers as well.",
        "I can't find any open finding for RULE-1 in the last run, so the login form is clean at the moment.",
    ],
)
def test_words_of_refusal_in_an_answer(output):
    assert P.defect_of(ASK, output) is None


@pytest.mark.parametrize(
    "output",
    [
        "The value of x reaches y without being", "Sure.\n\n```tool_call\n{\"tool\": \"scan_fi", "Use this:\n\n```python\nx = f(", "1. Check the input.\n2.", "The guard in", "Here is the fix:", "Bind it (see the", 'He said: "the value is', "Replace the constant, and", "この規則は、要求から来た値を",
    ],
)
def test_truncated(output):
    assert P.defect_of(ASK, output) == "truncated"


@pytest.mark.parametrize("output", ["Done.\n\n```python\nx = 1\n```", "It says: \"Il reste 3 constats dans ce module.\"", "| a | b |\n| - | - |\n| c | d |", "1. Check it.\n2. Fix it.", "この規則は値を報告します。"])
def test_complete(output):
    assert not P.is_truncated(output)


GERMAN = "Der Wert erreicht die Funktion ungeprüft, deshalb kann ein Aufrufer bestimmen, welche Datei geöffnet wird."
ENGLISH = "The value reaches the function without being checked, so a caller can choose what it opens."


@pytest.mark.parametrize(
    ("instruction", "output", "want"),
    [
        (ASK, GERMAN, "other_language"), ("Erkläre mir bitte, was PY-XSS-101 meldet", ENGLISH, "other_language"), ("Erkläre mir bitte, was PY-XSS-101 meldet", GERMAN, None), ("Answer in German: " + ASK, GERMAN, None), ("Antworte auf Englisch: was meldet die Regel?", ENGLISH, None),
        ("Answer in French: " + ASK, GERMAN, "other_language"), (ASK, "この規則は、要求から来た値を無害化せずに使う呼び出しを報告します。", "other_language"), (ASK, "Правило сообщает о вызовах.", "other_language"), (ASK, f'The comment says: "{GERMAN}"', None), (None, GERMAN, None),
    ],
)
def test_language(instruction, output, want):
    assert P.defect_of(instruction, output) == want


def test_suffix_automaton_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = [rnd.choice("abc") for _ in range(rnd.randint(0, 25))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 25))]
        held = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max((k for k in range(e + 2) if not k or tuple(b[e + 1 - k : e + 1]) in held), default=0) for e in range(len(b))]
        assert P.SuffixAutomaton(a).matches(b) == want


def test_operator(spark):
    rows = [(1, ASK, None), (1, ASK, None), (2, None, ENGLISH), (3, ASK, ENGLISH), (4, ASK, "x " * 200_000 + "."), (5, None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "pair_id long, instruction string, output string, defect string, i string")
    assert sorted((r.pair_id, r.defect) for r in P.find_defects(df).collect()) == [(1, "empty"), (1, "empty"), (5, "empty")]
    assert P.find_defects(df.limit(0)).count() == 0
    assert P.describe_pairs(df).count() == 6


def test_delimiters_are_read_in_every_paragraph():
    assert P.defect_of("Show the call.", "foo(bar, [1, 2\n\nDone.") == "truncated"
    assert P.defect_of("Show the call.", "foo(bar, [1, 2])\n\nDone.") is None


def test_brief_answers_without_full_stop():
    for text in ("The value is unchecked", "Yes, it does", "No, they are not"):
        assert P.defect_of("Is the value checked?", text) is None
    for text in ("The value is", "Resolve the path first, then compare it", "No change is nee"):
        assert P.defect_of("Is the value checked?", text) == "truncated"


@pytest.mark.parametrize(
    "output",
    [
        "Regeln gäller för filen eftersom det är en av de som inte har kontrollerats och därför måste du se till det.",
        "Quy tắc này áp dụng cho tệp vì giá trị không được kiểm tra trước khi sử dụng.",
        "Pravilo se odnosi na ovu datoteku jer vrijednost nije provjerena prije nego što je korištena.",
        "Pravilo velja za to datoteko, ker vrednost ni bila preverjena pred uporabo in mora biti.",
        "Ang patakaran ay para sa file na ito dahil hindi sinuri ang halaga bago ito gamitin.",
    ],
)
def test_further_languages(output):
    assert P.defect_of("Which rule applies to the login file and why is it so important?", output) == "other_language"


def test_an_instruction_is_in_the_language_of_most_of_its_paragraphs():
    handed = "Erkläre bitte, warum die Datei geändert wurde.\n\nThe file was changed because the value is not checked and this is what we found.\n\nWelche Regel gilt hier und warum?"
    assert P.defect_of(handed, "Die Regel gilt hier, weil der Wert nicht geprüft wird.") is None
    assert P.defect_of(handed, "The rule is for this file because the value is not checked before it is used.") == "other_language"
