"""Deterministic stand-ins for model functions, used by tests and the
registered demonstration queries. They depend only on their input text, so
results are reproducible and expressible in SQL."""

from __future__ import annotations

import re
import threading


def solver_factory():
    """Answers 'The answer is d.' with d = (len(prompt) + sample) % 10."""
    def fn(prompts, n):
        return [[f"Let me think. The answer is {(len(p) + j) % 10}." for j in range(n)] for p in prompts]
    return fn


def augmenter_factory():
    """Writes harder candidates: a task, a solution with a tagged answer, and
    a program printing a number; every third candidate prints a wrong one."""
    def fn(prompts, n):
        out = []
        for p in prompts:
            base = len(p) % 50
            cands = []
            for j in range(n):
                ans = base + j + 1
                printed = ans if j % 3 else ans + 1
                cands.append(f"<task>Harder {j}: {p}</task>\n<solution>Step 1. Add.\n"
                             f"<answer>{ans}</answer></solution>\n<code>\n```python\nprint({printed})\n```\n</code>")
            out.append(cands)
        return out
    return fn


def print_runner_factory():
    """Runner that 'executes' programs of the form print(<number>)."""
    rx = re.compile(r"print\((-?\d+(?:\.\d+)?)\)")

    def run(code, timeout):
        m = rx.search(code)
        if not m:
            raise RuntimeError("unsupported program")
        return m.group(1)
    return run


def length_reward_factory():
    def fn(text):
        return float(len(text) % 97) / 97.0
    return fn


def refusing_solver_factory():
    """Like the solver, but fails every call whose batch holds a prompt
    containing 'bad' (exercises retries and per-row errors)."""
    def fn(prompts, n):
        if any("bad" in p for p in prompts):
            raise RuntimeError("model refused")
        return [[f"The answer is {len(p)}" for _ in range(n)] for p in prompts]
    return fn


def scorer_factory():
    """Blank-separated tokens with log-probs from their lengths."""
    def fn(prompt, answer):
        tokens = answer.split(" ")
        return tokens, [-((len(t) % 5) + 1) / 4 for t in tokens]
    return fn


def program_factory():
    """Prints the prompt's last number, or one more than it if it is odd."""
    def fn(prompts, n):
        out = []
        for p in prompts:
            v = int(p.rsplit(" ", 1)[1])
            out.append([f"<code>\n```python\nprint({v + v % 2})\n```\n</code>"] * n)
        return out
    return fn


def repair_factory():
    """Adds the missing solution to a reply sent as 'Repair: ...'."""
    def fn(prompts, n):
        return [[p.removeprefix("Repair: ") + "<solution>#### 1</solution>"] * n for p in prompts]
    return fn


def harder_factory():
    """Answers 'Q: ...' with a harder question and its answer."""
    def fn(prompts, n):
        return [[f"Harder Question: Now twice. {p.removeprefix('Q: ')}\nHarder Answer: {len(p)}"] * n for p in prompts]
    return fn


def verifier_factory():
    """Accepts prompts whose length is not divisible by 3."""
    def fn(prompts, n):
        return [[f"Checked. Verification Result: {bool(len(p) % 3)} [[{'AB'[len(p) % 2]}]]"] * n for p in prompts]
    return fn


def tagged_augmenter_factory():
    """For a conversation: the first reply lacks a solution, later ones are complete; every second one prints the
    right number."""
    def fn(prompts, n):
        out = []
        for p in prompts:
            turn = p.count("<|im_start|>assistant") - 1
            sol = "" if turn == 0 else f"<solution>Add.\n#### {turn + 3}</solution>"
            out.append([f"<task>Task {turn}</task>{sol}<code>```python\nprint({turn + 3 + (turn % 2 == 0)})\n```</code>"] * n)
        return out
    return fn


def flaky_factory():
    """Answers 'Q <number>' with the number; a prompt fails as often as its number modulo 4 before it is answered."""
    lock, sent = threading.Lock(), {}

    def fn(prompts, n):
        for p in prompts:
            with lock:
                sent[p] = sent.get(p, 0) + 1
            if sent[p] <= int(p.rsplit(" ", 1)[1]) % 4:
                raise ConnectionError(f"try {sent[p]}")
        return [[f"The answer is {p.rsplit(' ', 1)[1]}"] * n for p in prompts]
    return fn
