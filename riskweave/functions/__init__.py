from .columns import (  # noqa: F401
    bounded,
    floor_days,
    guarded_ratio,
    hash_unit,
    log1p_floor,
    micros,
    nan_to_null,
    one_if,
    ranked_hash,
    seconds_to_micros,
)
