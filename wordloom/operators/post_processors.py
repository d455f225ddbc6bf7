"""Post-processors: put special tokens around token arrays. A stage takes (tokens, pair or None, add_special)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import settings as s

Stage = Callable[[Column, "Column | None", bool], Column]

#: White space within a line.
SPACE = "[\\p{Zs}\\t]"


def _one(token: str) -> Column:
    return F.array(F.lit(token))


def plain(tokens: Column, pair: Column | None = None, add_special: bool = True) -> Column:
    return tokens if pair is None else F.concat(tokens, pair)


def template(single: list[dict], pair_items: list[dict]) -> Stage:
    def run(tokens: Column, pair: Column | None = None, add_special: bool = True) -> Column:
        parts = []
        for item in single if pair is None else pair_items:
            if isinstance(token := item.get("SpecialToken"), dict):
                if add_special:
                    parts.append(_one(token.get("id", "")))
            elif isinstance(part := item.get("Sequence"), dict):
                own = tokens if part.get("id") == "A" else pair if part.get("id") == "B" else None
                if own is not None:
                    parts.append(own)
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    return run


def bert(cls: str, sep: str) -> Stage:
    def run(tokens: Column, pair: Column | None = None, add_special: bool = True) -> Column:
        if not add_special:
            return plain(tokens, pair)
        out = F.concat(_one(cls), tokens, _one(sep))
        return out if pair is None else F.when(F.size(pair) > 0, F.concat(out, pair, _one(sep))).otherwise(out)

    return run


def trim(token: Column, keep_one: bool) -> Column:
    """White space at both ends, all of it or all but one character."""
    if keep_one:
        only = F.when(F.length(token) > 1, F.lit("")).otherwise(token)
        cut = F.regexp_replace(F.regexp_replace(token, f"^{SPACE}+(?={SPACE})", ""), f"(?<={SPACE}){SPACE}+\\z", "")
        return F.when(token.rlike(f"^{SPACE}+\\z"), only).otherwise(cut)
    return F.regexp_replace(F.regexp_replace(token, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def roberta(cls: str, sep: str, trim_offsets: bool = True, add_prefix_space: bool = True) -> Stage:
    def run(tokens: Column, pair: Column | None = None, add_special: bool = True) -> Column:
        if not add_special:
            return plain(tokens, pair)
        cut = (lambda a: F.transform(a, lambda t: trim(t, add_prefix_space))) if trim_offsets else (lambda a: a)
        out = F.concat(_one(cls), cut(tokens), _one(sep))
        if pair is None:
            return out
        # two separators between the parts
        return F.when(F.size(pair) > 0, F.concat(out, _one(sep), cut(pair), _one(sep))).otherwise(out)

    return run


def sequence(stages: list[Stage]) -> Stage:
    def run(tokens: Column, pair: Column | None = None, add_special: bool = True) -> Column:
        for stage in stages:
            tokens, pair = stage(tokens, pair, add_special), None
        return tokens

    return run


def _name(config: dict, key: str) -> str:
    v = s.items(config, key, [])
    if not v or not isinstance(v[0], str):
        raise ValueError(f"the post-processor names no {key} token")
    return v[0]


def build(config: dict | None) -> Stage | None:
    kind = s.text(config, "type")
    if kind == "TemplateProcessing":
        single, pair = s.items(config, "single"), s.items(config, "pair")
        if single is None or pair is None:
            raise ValueError("a template needs both single and pair")
        return template(single, pair)
    if kind == "BertProcessing":
        return bert(_name(config, "cls"), _name(config, "sep"))
    if kind == "RobertaProcessing":
        trims = next((v for k in ("trimOffset", "trim_offset", "trimOffsets", "trim_offsets") if isinstance(v := config.get(k), (bool, int, float))), True)
        return roberta(_name(config, "cls"), _name(config, "sep"), bool(trims), s.flag(config, "add_prefix_space", True))
    if kind == "Sequence":
        return sequence([x for x in map(build, s.items(config, "processors", [])) if x])
    return {"ByteLevel": plain, **REGISTERED}.get(kind)


#: Stages of callers, by type.
REGISTERED: dict[str, Stage] = {}
