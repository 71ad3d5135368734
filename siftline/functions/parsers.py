"""Small parsers and rules on plain values."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

from siftline.functions.jsons import decoded


def replace_names(text: str, names: dict[str, str]) -> str:
    """Identifiers replaced at word boundaries, longest first."""
    if not names:
        return text
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?!\w)")
    return pattern.sub(lambda m: names[m[0]], text)


def containing(name: str, candidates: list[str]) -> str:
    """The one candidate that a name contains; none or several raise."""
    found = [c for c in candidates if c in name]
    if len(found) != 1:
        raise ValueError(f"{name} matches {found}")
    return found[0]


def function_names(value: Any) -> set[str]:
    """Every name and function_name at any depth."""
    if isinstance(value, dict):
        own = {v for k, v in value.items() if k in ("name", "function_name") and isinstance(v, str)}
        return own.union(*map(function_names, value.values()))
    return set().union(*map(function_names, value)) if isinstance(value, list) and value else set()


def natural_request(content: str) -> str | None:
    """The request of a reply: fence stripped, JSON, else the first object in the text."""
    body = re.sub(r"^```\w*\n?|\n?```$", "", content.strip()).strip()
    for text in (body, *(m[0] for m in [re.search(r"\{.*\}", body, re.S)] if m)):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("natural_request"), str):
            return value["natural_request"]
    return None


def python_calls(text: str) -> str:
    """tool_call blocks as Python call text; several as a list; none raises."""
    out = []
    for block in re.findall(r"<tool_call>(.*?)</tool_call>", text.rsplit("</think>", 1)[-1], re.S):
        name = re.search(r"<function=([^>]+)>", block)
        if name:
            args = [f"{k.strip()}={literal(v.strip())!r}" for k, v in re.findall(r"<parameter=([^>]+)>(.*?)</parameter>", block, re.S)]
            out.append(f"{name[1].strip()}({', '.join(args)})")
    if not out:
        raise ValueError("no tool call")
    return out[0] if len(out) == 1 else "[" + ", ".join(out) + "]"


def literal(text: str) -> Any:
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError):
            pass
    return text


def declared_tools(content: str, head: str, end: str) -> list | None:
    """A JSON list of tools between fixed marks of an older format."""
    if not content.startswith(head):
        return None
    try:
        return decoded(content[len(head) :].removesuffix(end), list)
    except ValueError:
        return None


def tier_mix(text: str, tiers: tuple[str, ...] = ("T1", "T2", "T3", "T4")) -> dict[str, float]:
    """Y32: "T1:0,T2:0.45,..": all tiers, none negative, sum 1."""
    mix = {k: float(v) for k, _, v in (p.strip().partition(":") for p in text.split(","))}
    if set(mix) != set(tiers) or min(mix.values()) < 0 or abs(sum(mix.values()) - 1) > 1e-9:
        raise ValueError(f"not a mix of {tiers}: {text}")
    return mix


def arm_spec(text: str) -> tuple[str, str, int, float]:
    """name=path:top_k:alpha, split from the right."""
    m = re.fullmatch(r"([^=]+)=(.+):(\d+):([0-9.]+)", text)
    if not m or not 1 <= int(m[3]) or not 0 <= float(m[4]) <= 1:
        raise ValueError(f"expected name=path:top_k:alpha: {text}")
    return m[1], m[2], int(m[3]), float(m[4])
