import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from answerframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def _question(q_type, question, candidates, answer, **more):
    return {"q_type": q_type, "question": question, "candidate_answers": candidates, "answer": answer, **more}


@pytest.fixture
def sample():
    """A harbour in three stories: a plain text, one in parts, and one that nothing is asked about."""
    relation = _question("FR", "Where is the ferry, seen from the crane?", [*range(8)], [0, 4], level=3)
    lamp = _question("CO", "What is lit at night?", ["ferry", "lamp", "each", "not one"], [3], q_id="n-18")
    docks = _question("FB", "At which docks do nets dry?", ["C", "A", "B"], ["C", "A"], q_id=None)
    full = _question("YN", "Is dock B full?", [], ["No"], q_id=907, tags=["count", "dock"])
    older = _question("YN", "Is the pilot older than the mate?", [], ["DK"], q_id="n-2")
    return {
        "name": "harbour",
        "data": [
            {"story": "The ferry waits left of the crane and far from it. No lamp burns.", "questions": [lamp, relation]},
            {"story": ["Nets dry at dock C.", "So they do at A.", "One berth of B is free."], "questions": [docks, full, older]},
            {"story": ["Gulls sleep."], "questions": []},
        ],
    }
