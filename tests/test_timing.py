import logging

import pytest

from quadrille.functions.timing import timed


def test_steps_are_logged(caplog):
    with caplog.at_level(logging.INFO, "quadrille"), timed("a step") as took:
        pass
    assert took["s"] >= 0 and caplog.messages[-1].startswith("a step took ")
    with caplog.at_level(logging.INFO, "quadrille"), pytest.raises(KeyError), timed("another"):
        raise KeyError
    assert caplog.messages[-1].startswith("another failed after ")
