"""Plain-Python model of the pairing and encoding semantics.

Written from the written semantics, used only to cross-check the Spark jobs
on random inputs.
"""

from __future__ import annotations

import math
from itertools import combinations

IGN = -100
S, E, EOD = 0x110000, 0x110001, 0x110002
NL = [10]
SYSTEM = "You are a helpful assistant."


def score(annotations):
    """Mean of float(Rating) over the aspects; None if any fails to parse."""
    if annotations is None:
        return None
    vals = []
    for v in annotations.values():
        if v is None or v.get("Rating") is None:
            return None
        try:
            vals.append(float(v["Rating"]))
        except ValueError:
            return None
    if not vals:
        return math.nan
    total = 0.0
    for x in vals:
        total += x
    return total / len(vals)


def pairs(responses, annotations):
    out = []
    scores = [score(a) for a in annotations]
    for i, j in combinations(range(len(annotations)), 2):
        si, sj = scores[i], scores[j]
        if si is None or sj is None:
            continue
        if si > sj:
            hi, lo = i, j
        elif sj > si:
            hi, lo = j, i
        else:
            continue
        if hi >= len(responses) or lo >= len(responses) or responses[hi] is None or responses[lo] is None:
            continue
        out.append((i, j, responses[hi], responses[lo]))
    return out


def cp(text):
    return [ord(c) for c in text]


def segment(role, text):
    header = [S] + cp(role)
    ids = header + NL + cp(text) + [E] + NL
    if role == "user":
        labels = [S] + [IGN] * (len(ids) - 3) + [E] + NL
    else:
        labels = [S] + [IGN] * len(header) + cp(text) + [E] + NL
    return ids, labels


def system_segment():
    ids = [S] + cp("system") + NL + cp(SYSTEM) + [E] + NL
    return ids, [S] + [IGN] * (len(ids) - 3) + [E] + NL


def mask(ids, pad=EOD, eos=EOD):
    return [0 if (x == pad or x == eos) else 1 for x in ids]


def encode(prompt, chosen, rejected, max_length, max_prompt_length, mode="keep_end"):
    sys_ids, sys_lab = system_segment()
    u_ids, u_lab = segment("user", prompt)
    p = {"input_ids": sys_ids + u_ids, "labels": sys_lab + u_lab}
    p["attention_mask"] = mask(p["input_ids"])
    sides = {}
    for name, text in (("chosen", chosen), ("rejected", rejected)):
        ids, lab = segment("assistant", text)
        sides[name] = {"input_ids": ids + [EOD], "labels": lab + [EOD], "attention_mask": mask(ids) + [1]}
    longer = max(len(sides["chosen"]["input_ids"]), len(sides["rejected"]["input_ids"]))
    if len(p["input_ids"]) + longer > max_length:
        if mode == "keep_start":
            p = {k: v[:max_prompt_length] for k, v in p.items()}
        else:
            p = {k: v[-max_prompt_length:] for k, v in p.items()}
    if len(p["input_ids"]) + longer > max_length:
        keep = max_length - max_prompt_length
        sides = {n: {k: v[:keep] for k, v in d.items()} for n, d in sides.items()}
    out = {}
    for n, d in sides.items():
        out[f"{n}_input_ids"] = p["input_ids"] + d["input_ids"]
        out[f"{n}_labels"] = [IGN] * len(p["input_ids"]) + d["labels"]
        out[f"{n}_attention_mask"] = p["attention_mask"] + d["attention_mask"]
    for k, v in p.items():
        out[f"prompt_{k}"] = v
    return out
