"""A provider of texts and vectors for tests."""

import json


def answer(prompt: str) -> str:
    """Wrong at first, right once the problems are named."""
    good = "Problems of the previous answer" in prompt
    q = {"question_id": "q1", "answer": "A", "evidence": {"quality": "low", "rationale": "r", "citations": [{"source_title": "T", "locator": "p. 1", "source_id": "SRC1"}]}}
    return json.dumps({"job_id": "phase1_discovery_qa", "spec_id": "s", "generated_at": "2024-01-01", "questions": [q] if good else []})


def broken(prompt: str) -> str:
    return "no JSON"


def vectors(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]
