"""The same rules at every length: outputs, credentials and numbers that are long or unusually written."""

import pytest

from weftline.llm import pairs as P
from weftline.llm import pii as I
from weftline.llm import secrets as S

ASK = "Which rules cover CWE-89 in python code and which of them are enabled by default?"
LINE = "cursor.execute('select * from t where id = ' + user)"


@pytest.mark.parametrize("output", ["<p></p>\n" * 80, "null" + " " * 500, "​" * 450 + "N/A", "```\n```\n" * 70])
def test_long_empty_outputs(output):
    assert P.defect_of(ASK, output) == "empty"


def test_a_prompt_given_back_many_times_is_an_echo():
    assert P.defect_of(ASK, "\n".join([ASK] * 9)) == "echo"
    assert P.defect_of(ASK, "\n".join([ASK] * 9) + "\nPY-SQLI-101 covers it.") is None


@pytest.mark.parametrize(
    "output",
    [
        "I'm sorry, but I can't help with that request. " + "Requests of this kind touch on matters that a security professional in your organisation should look at with you, calmly and with all of the context at hand. " * 4 + "I will not say more about it.",
        f"I cannot help with this code:\n\n```python\n{LINE}\n{LINE}\n{LINE}\n{LINE}\n{LINE}\n{LINE}\n```\n\nPlease ask a security professional.",
    ],
)
def test_long_refusals_and_refusals_that_quote_code(output):
    assert P.defect_of(f"Explain this:\n{LINE}", output) == "refusal"


def test_answers_with_one_refusing_sentence():
    assert P.defect_of(ASK, "I can't run the scanner here. " + "The rule PY-SQLI-101 covers it and is enabled for every python file. " * 12) is None
    assert P.defect_of(ASK, "I can't run it here, but this works:\n\n```python\n" + "\n".join(f"check_{i}(rule)" for i in range(12)) + "\n```\n") is None


LONG = "".join(f"{chr(97 + i * 7 % 26)}{chr(65 + i * 11 % 26)}{i * 13 % 10}" for i in range(2000))


@pytest.mark.parametrize(
    "text",
    [
        "aws --session-token {} s3 ls", "curl 'https://a.example/x?sig={}&v=1'", "curl -H 'Authorization: Bearer {}' https://a.example", "conn = Server=db;Password={};Timeout=3", "postgres://app:{}@db.example/x",
        "<password>{}</password>", "password = \"{}\"", "sshpass -p '{}' ssh a@b",
    ],
)
@pytest.mark.parametrize("size", [150, 450, 5000])
def test_long_credentials_are_redacted_to_their_end(text, size):
    secret = LONG[:size]
    whole = text.format(secret)
    done = S.redact(whole, S.find_secrets(whole))
    assert secret[-40:] not in done and S.MASK in done


@pytest.mark.parametrize(("line", "found"), [('password = "correct horse battery staple"', True), ('passphrase: "glacier Mango7 trumpet orbit"', True), ('password = "Password must be eight characters"', False), ('secret = "value is not set yet"', False), ('label = "correct horse battery staple"', False)])
def test_passphrases_of_several_words(line, found):
    assert bool(S.find_secrets(line, "py")) is found


@pytest.mark.parametrize("number", ["912.34.56.78", "912 34 56 78"])
def test_numbers_in_the_form_of_addresses_are_found(number):
    text = f"Tel. {number}"
    assert [(i.kind, text[i.start : i.end]) for i in I.find_pii(text)] == [("phone", number)]


@pytest.mark.parametrize("line", ["connect to 10.20.30.40:8080", "peers 192.168.100.200, 172.16.254.100", "2025-03-24T08:31:12Z 10.0.12.134 WARN"])
def test_network_addresses_are_no_numbers_of_persons(line):
    assert I.find_pii(line) == []
