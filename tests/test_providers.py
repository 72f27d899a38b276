"""The hosted provider with a stubbed transport."""

import json

import pytest

from plumbline.plans import providers
from plumbline.plans.suggest import CodeSuggestion, SuggestionError

CONFIG = providers.ModelConfig("m-1", "http://nowhere.invalid", "k", temperature_prefixes=("m-",))
FIELDS = {"issue_detected": "i", "theory_explanation": "t", "python_code": "df = df", "columns_affected": ["a"], "execution_order": 0}


def answer(content, reason="stop", refusal=None):
    return 200, {"choices": [{"finish_reason": reason, "message": {"content": content, "refusal": refusal}}]}


def test_answer_is_checked():
    sent = []
    model = providers.HostedModel(CONFIG, lambda c, b: (sent.append(b), answer(json.dumps(FIELDS)))[1])
    got = model.suggest("s", "u", {})
    assert isinstance(got, CodeSuggestion) and got.execution_order == 1 and sent[0]["temperature"] == 0.0
    other = providers.HostedModel(providers.ModelConfig("x", "u", "k"), lambda c, b: answer("{}"))
    assert "temperature" not in other.body("s", "u") and other.name != model.name


@pytest.mark.parametrize("reply, error", [
    ((401, {"error": {"message": "no"}}), providers.AuthError), ((403, {}), providers.AuthError), ((429, {}), providers.RateError), ((429, {"error": {"code": "insufficient_quota"}}), providers.QuotaError), ((402, {}), providers.QuotaError), ((503, {}), providers.OverloadError), ((400, {"error": "bad"}), SuggestionError),
    (answer("{", "length"), providers.AnswerError), (answer("", refusal="no"), providers.AnswerError), (answer("not json"), providers.AnswerError), ((200, {}), providers.AnswerError), (answer('{"issue_detected": "x"}'), providers.AnswerError),
])
def test_errors_are_typed(reply, error):
    with pytest.raises(error):
        providers.HostedModel(CONFIG, lambda c, b: reply).suggest("s", "u", {})


def test_config_comes_from_the_environment():
    with pytest.raises(providers.AuthError):
        providers.default_config({})
    assert providers.default_config({"PLUMBLINE_MODEL": "a", "PLUMBLINE_URL": "b", "PLUMBLINE_API_KEY": "c"}).model == "a"


def test_providers_have_an_order():
    two = {f"PLUMBLINE_{p}_{k}": f"{p}-{k}" for p in ("NEAR", "FAR") for k in ("URL", "MODEL", "API_KEY")}
    pick = lambda extra=None, **given: (lambda c: (c.url, c.model, c.api_key))(providers.default_config({**two, **(extra or {})}, **given))
    assert pick() == ("FAR-URL", "FAR-MODEL", "FAR-API_KEY") and pick({"PLUMBLINE_PROVIDER": " near "})[0] == "NEAR-URL" and pick({"PLUMBLINE_PROVIDER": "odd"})[0] == "FAR-URL"
    assert pick({"PLUMBLINE_FAR_API_KEY": ""})[0] == "NEAR-URL" and pick({"PLUMBLINE_MODEL": "m"})[1] == "m"
    assert pick({"PLUMBLINE_MODEL": "m"}, provider="near") == ("NEAR-URL", "NEAR-MODEL", "NEAR-API_KEY") and pick(provider="near", model="x", api_key="k")[1:] == ("x", "k")
    with pytest.raises(ValueError):
        pick(provider="none")
