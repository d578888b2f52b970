"""Model parameters: typed, ranged, rejected when unknown."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from enum import Enum


class ResizeMethod(Enum):
    NONE = "none"
    SHORT_EDGE = "scale short edge"
    LONG_EDGE = "scale long edge"
    WIDTH = "scale width"
    HEIGHT = "scale height"
    SCALE_AND_CROP = "scale and crop"


class Response(Enum):
    DOT = "dot"
    NORM_DOT = "norm_dot"
    RBF = "rbf"
    NORM_RBF = "norm_rbf"


@dataclass
class Params:
    image_resize_method: ResizeMethod = ResizeMethod.SHORT_EDGE
    image_resize_length: int = 220
    image_resize_aspect_ratio: float = 1.0
    retina_bias: float = 1.0
    retina_enabled: bool = False
    retina_kwidth: int = 15
    s1_beta: float = 1.0
    s1_bias: float = 0.01
    s1_kwidth: int = 11
    s1_num_orientations: int = 4
    s1_num_phases: int = 2
    s1_sampling: int = 1
    s1_shift_orientations: bool = True
    s1_operation: Response = Response.NORM_DOT
    c1_kwidth: int = 11
    c1_sampling: int = 5
    c1_whiten: bool = False
    s2_beta: float = 5.0
    s2_bias: float = 0.1
    s2_kwidth: list[int] = field(default_factory=lambda: [7])
    s2_sampling: int = 1
    s2_operation: Response = Response.RBF
    num_scales: int = 9
    scale_factor: float = 2 ** 0.25

    def __post_init__(self):
        if isinstance(self.s2_kwidth, int):
            self.s2_kwidth = [self.s2_kwidth]
        self.validate()

    def validate(self) -> None:
        positive = ("image_resize_length", "image_resize_aspect_ratio", "retina_kwidth", "s1_beta", "s1_kwidth", "s1_num_orientations", "s1_num_phases", "s1_sampling", "c1_kwidth", "c1_sampling", "s2_beta", "s2_sampling")
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        for name in ("retina_bias", "s1_bias", "s2_bias", "num_scales"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.scale_factor < 1:
            raise ValueError("scale_factor must be at least 1")
        if not self.s2_kwidth or min(self.s2_kwidth) <= 0:
            raise ValueError("s2_kwidth needs at least one width above 0")

    @classmethod
    def from_dict(cls, values: dict) -> Params:
        kinds = {"image_resize_method": ResizeMethod, "s1_operation": Response, "s2_operation": Response}
        known = {f.name for f in fields(cls)}
        if odd := set(values) - known:
            raise ValueError(f"unknown parameters: {sorted(odd)}")
        return cls(**{k: kinds[k](v) if k in kinds and not isinstance(v, Enum) else v for k, v in values.items()})

    def to_dict(self) -> dict:
        return {f.name: v.value if isinstance(v := getattr(self, f.name), Enum) else v for f in fields(self)}
