"""Triggers beside marks beyond ASCII."""

import pytest

from quarrymill.llm import toxicity


@pytest.mark.parametrize("mark", ["\U0001f600", "\u3002", "\uff01", "\u200b", "\u2026", " \u00e9"])
def test_any_mark_ends_a_word(mark):
    model = toxicity.Model(toxicity.base_classes())
    assert model.features("you are an idiot" + mark) == model.features("you are an idiot" + (mark if mark == "\u2026" else "!" if mark != " \u00e9" else " x"))
    assert toxicity.any_trigger("you are an idiot" + mark, model.triggers)
