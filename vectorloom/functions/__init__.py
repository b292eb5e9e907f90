from vectorloom.functions.scalars import (  # noqa: F401
    fold_of,
    hours,
    iso_shifted,
    minutes,
    parent_dir,
    percent_text,
    run_mode,
    run_slots,
    split_of,
)
from vectorloom.functions.vectors import (  # noqa: F401
    arg_max,
    column_at,
    features_of,
    feature_slice,
    label_slice,
    one_hot_index,
    one_hot_name,
    pick_columns,
    softmax,
    with_one_hot,
)
