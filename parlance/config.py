"""Parameters of the conversation engine; the defaults are those of the blueprint's section 2.15."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

MARKERS = ("system", "/system", "context", "/context", "conversation", "/conversation", "agent", "customer")
WINDOWS = {"w1": 2, "w2": 4, "w3": 6, "w5": 10, "w10": 20}
SYSTEM_PROMPT = "You are a helpful agent. Answer the customer briefly and politely."
CONTEXTS = ("The customer has an open order.", "The customer asked for a call back.", "The customer is new.", "The customer renewed recently.", "The customer prefers e-mail.")


def marker(name: str) -> str:
    return f"<|{name}|>"


@dataclass(frozen=True)
class Config:
    min_agent_tokens: int = 15
    context_rate: float = 0.15
    history_turns: int = 20
    min_turns_training: int = 4
    min_turns_indexing: int = 2
    max_seq_len: int = 4096
    label_mask: int = -100
    percentiles: tuple[int, ...] = (50, 75, 90, 95, 99, 100)
    histogram_bins: int = 50
    norm_epsilon: float = 1e-8
    top_k: int = 5
    eval_states: int = 80
    trials: int = 50
    holdout: int = 30
    eval_seed: int = 42
    holdout_seed: int = 99
    weight_range: tuple[float, float] = (0.01, 10.0)
    poor_rating: int = 2
    failures_shown: int = 5
    position_cuts: tuple[float, float] = (0.33, 0.67)
    system_prompt: str = SYSTEM_PROMPT
    contexts: tuple[str, ...] = field(default=CONTEXTS)


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line of a training-data run; what trains a model is taken and left to the trainer."""
    p = argparse.ArgumentParser(description="Build packed training examples from transcripts")
    p.add_argument("--model-dir", default="")
    p.add_argument("--quantization", choices=("lora", "qlora"), default="lora")
    p.add_argument("--data-file", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--epochs", type=int, default=3)
    p.add_argument("--max-seq-len", type=int, default=Config.max_seq_len)
    return p.parse_args(argv)
