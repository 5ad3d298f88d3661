import random

import pytest

ZH = "肝心脾肺肾胆胃肠热寒虚实气血阴阳痰湿风火燥毒瘀滞汗咳喘痛胀麻木眩晕呕泻渴烦躁悸"


@pytest.fixture(scope="session")
def sentence():
    """A function of a seed: a plain sentence of invented words."""

    def make(seed, n=24):
        rng = random.Random(str(seed))
        return "".join(rng.choice(ZH) for _ in range(n)) + "。"

    return make


#: Columns whose names the operators use inside.
CLASH = {"key": "string", "n": "int", "total": "int", "keys": "string", "text": "string", "field": "string", "copies": "int", "content": "int", "item": "int", "row": "int", "tokens": "int", "band": "int"}


@pytest.fixture(scope="session")
def odd_bank(items):
    """A bank of awkward rows: nulls everywhere, empty and very long texts, repeated rows, clashing extra columns."""
    nulls = {k: None for k in ("stem", "options", "answer", "explanation", "source", "shared_options", "subject_id", "type", "unit", "number")}
    long = "肝主疏泄其变动为目眩。" * 4000
    same = {"id": "r1", "stem": "同", "options": {"A": "甲"}, "explanation": "同一解析。"}
    return items(nulls | {"id": "n1"}, {"id": "e1", "stem": "", "explanation": "", "options": {}}, {"id": "v1", "stem": long, "explanation": long, "options": {"A": None, "B": long}}, same, same, {"id": "o1", "shared_options": {"A": None, "Z": "x"}}, extra=CLASH)
