"""Assignment-aware lexing: syntaxes, scopes, values of many parts, hostile texts."""

import time

import pytest

from inkstream.llm import secrets

PW = "hT7q!kd92Ls"
#: text -> the literals that are secrets in it
PLANTED = {
    f"<password>{PW}</password>": [PW],
    f'<add key="DbPassword" value="{PW}"/>': [PW],
    f'cfg.setPassword("{PW}");': [PW],
    f'client.put("api_key", "{PW}")': [PW],
    f'get_password("{PW}")': [],
    f'assert_equal("password", "{PW}")': [],
    'token = """hT7q\nkd92Ls"""': [],
    "secret = '''hT7qkd92Ls'''": ["hT7qkd92Ls"],
    "secret: |\n  hT7qkd92Ls\n  Zk29dl2Qq\nother: x\n": ["hT7qkd92Ls", "Zk29dl2Qq"],
    "export PW=${DB_PASSWORD:-hT7qkd92Ls}": ["hT7qkd92Ls"],
    f'user, password = "bob", "{PW}"': [PW],
    'password = ("hT7q"\n  "kd92Ls")': ["hT7q", "kd92Ls"],
    f'def a():\n    x = "{PW}"\n    return x\ndef b():\n    token = x\n': [],
    f'function a() {{ var x = "{PW}"; }}\nfunction b() {{ var token = x; }}': [],
    f'base = "{PW}"\ndef b():\n    token = base\n': [PW],
    "--set=token=hT7qkd92Ls": ["hT7qkd92Ls"],
    "mysql --password=hT7qkd92Ls== -u x": ["hT7qkd92Ls=="],
    "dsn=postgres://u:hT7qkd92Ls@h/x": ["postgres://u:hT7qkd92Ls@h/x"],
    f'secret_length = "{PW}"': [],
    "a token of her love: a ring": [],
    "the secret: nobody knows it yet": [],
    "api_key = os.environ['API_KEY']": [],
    'password = "<your password here>"': [],
    "token: ${TOKEN}": [],
}


def literals(text):
    return [text[s.start : s.end] for s in secrets.spans(text) if s.kind == "literal"]


@pytest.mark.parametrize("text", PLANTED)
def test_planted_cases(text):
    assert literals(text) == PLANTED[text]


def test_values_of_any_number_of_parts_are_followed():
    parts = [f"x{i}Q" for i in range(700)]
    assert literals("passphrase = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert sorted(literals('p = ""\n' + "".join(f'p += "{x}"\n' for x in parts) + "passphrase = p")) == sorted(parts)


HOSTILE = ["a=" * 20_000, "a:" * 20_000, "a, " * 20_000, '"' * 20_000, 'a="""' * 5000, "${a:-" * 10_000, "<a>" * 10_000, 'password += "x9Q"\n' * 5000, "x = 'a1B2c3'\n" + "x = x + x\n" * 5000 + "secret = x", "a = " + "(" * 20_000, "{" * 9000 + "}" * 9000]


@pytest.mark.parametrize("text", HOSTILE)
def test_lexing_takes_about_linear_time(text):
    began = time.process_time()
    secrets.spans(text)
    assert time.process_time() - began < 4


def test_scan_of_no_rows_and_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "token: abcdef12"), (1, "token: abcdef12"), (None, None)], "doc_id long, text string")
    assert secrets.scan(docs.limit(0)).count() == 0
    assert sorted(len(r.spans) for r in secrets.scan(docs).collect()) == [0, 2, 2]
