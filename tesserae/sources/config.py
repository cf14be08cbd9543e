"""Settings of constraint mining and attribution, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import yaml


@dataclass
class Config:
    label_col: list[str] = field(default_factory=list)
    drop_cols: list[str] = field(default_factory=list)
    sample_n: int | None = None
    sample_random_seed: int = 0
    max_key_size: int = 1
    max_lhs_size: int = 2
    fd_eps: float = 0.01
    cat_max_unique: int = 30
    id_unique_frac: float = 0.2
    max_rhs_domain: int = 20
    max_allowed_set: int = 20
    min_group_support: int = 30
    use_quantiles: bool = False
    q_lo: float = 0.005
    q_hi: float = 0.995
    id_name_tokens: list[str] = field(default_factory=lambda: ["id", "uuid", "code"])
    provenance_threshold: int = 1


#: Settings whose name in files differs from the field's (fixed values).
ALIASES = {"use_quantiles_for_conti_cate": "use_quantiles", "random_seed": "sample_random_seed"}


def load(path: str) -> Config:
    """Settings of a YAML file; unknown ones are ignored, single names may stand for lists."""
    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})


def from_dict(raw: dict) -> Config:
    known, out = {f.name: f for f in fields(Config)}, Config()
    for key, value in raw.items():
        name = ALIASES.get(key.lower(), key.lower())
        if name in known and value is not None:
            default = getattr(out, name)
            setattr(out, name, [value] if isinstance(default, list) and not isinstance(value, list) else value)
    if out.provenance_threshold < 1:
        raise ValueError("PROVENANCE_THRESHOLD must be 1 or more")
    return out
