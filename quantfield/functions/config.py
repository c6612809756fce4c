"""Settings of a compression plan: error mode, algorithm, predictors; as INI text and as JSON."""

from __future__ import annotations

import configparser
import io
import json
from dataclasses import asdict, dataclass, field

MODES = ("ABS", "REL", "PSNR", "L2NORM", "ABS_AND_REL", "ABS_OR_REL")
ALGORITHMS = ("LORENZO_REG", "INTERP_LORENZO", "INTERP", "NOPRED", "LOSSLESS", "BIOMD", "BIOMDXTC")
INTERPOLATIONS = ("LINEAR", "CUBIC")
#: Default block edge and anchor stride by rank.
BLOCK_EDGE = {1: 128, 2: 16, 3: 6, 4: 6}
ANCHOR_STRIDE = {1: 4096, 2: 128, 3: 32, 4: 16}


def normal_dims(dims: list[int]) -> list[int]:
    """Dimensions of one point say nothing; a field keeps at least one, and at most four."""
    kept = [int(d) for d in dims if d > 1] or [1]
    if len(kept) > 4:
        raise ValueError("fields have 1 to 4 dimensions")
    return kept


@dataclass
class Config:
    dims: list[int] = field(default_factory=lambda: [1])
    mode: str = "ABS"
    algorithm: str = "INTERP_LORENZO"
    abs_bound: float = 1e-3
    rel_bound: float = 0.0
    psnr: float = 0.0
    l2_bound: float = 0.0
    lorenzo: bool = True
    lorenzo2: bool = False
    regression: bool = True
    interpolation: str = "CUBIC"
    direction: int = 0
    radius: int = 32768
    alpha: float = 1.25
    beta: float = 2.0
    block: int = 0

    def __post_init__(self):
        self.dims = normal_dims(self.dims)
        self.block = self.block or BLOCK_EDGE[len(self.dims)]
        for value, known in ((self.mode, MODES), (self.algorithm, ALGORITHMS), (self.interpolation, INTERPOLATIONS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))

    def to_ini(self) -> str:
        p = configparser.ConfigParser()
        p["field"] = {k: json.dumps(v) if not isinstance(v, str) else v for k, v in asdict(self).items()}
        out = io.StringIO()
        p.write(out)
        return out.getvalue()

    @classmethod
    def from_ini(cls, text: str) -> Config:
        """Unknown keys and values are errors."""
        p = configparser.ConfigParser(inline_comment_prefixes="#")
        p.read_string(text)
        kinds = {k: type(v) for k, v in asdict(cls()).items()}
        found = {}
        for k, v in p["field"].items():
            if k not in kinds:
                raise ValueError(f"unknown setting {k!r}")
            found[k] = v if kinds[k] is str else json.loads(v)
        return cls(**found)
