"""Declared schemas and the configuration record."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

CONTACTS = "cell_name string, cell_id long, chrom1 string, pos1 long, chrom2 string, pos2 long, count double"
CELL_CONTACTS = "chrom1 string, pos1 long, chrom2 string, pos2 long, count double"
CHROM_SIZES = "chrom string, size long"
CYTOBAND = "chrom string, start long, end long, name string, type string"
CALIBRATION = "chrom string, bin long, value double"
BINS = "chrom string, start long, end long"
PIXELS = "cell_id long, chrom string, bin1 long, bin2 long, count double"
TRACKS = "cell_id long, chrom string, start long, end long, value double"


@dataclass(frozen=True)
class Config:
    """The keys of a run; unknown keys of a JSON file are refused."""

    chrom_list: tuple[str, ...] = ()
    resolution: int = 1_000_000
    resolution_cell: int = 1_000_000
    input_format: str = "whole"
    downsample: float = 1.0
    keep_inter: bool = False
    minimum_distance: int = -1
    maximum_distance: int = -1
    minimum_impute_distance: int = 0
    maximum_impute_distance: int = -1
    neighbor_num: int = 5
    dimensions: int = 64
    rank_thres: int = 1
    embedding_epoch: int = 60
    no_nbr_epoch: int = 45
    with_nbr_epoch: int = 30

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            raw = json.load(f)
        known = {f.name for f in fields(cls)}
        if unknown := raw.keys() - known:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
