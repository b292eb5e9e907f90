from vectorloom.sources.images import list_files, scan_images, shuffled, write_images  # noqa: F401
from vectorloom.sources.npy import NpyMatrixSource, npy_manifest, read_npy, write_npy  # noqa: F401
from vectorloom.sources.published_log import PUBLISHED_SCHEMA, publish_runs, published_runs  # noqa: F401
from vectorloom.sources.runlog import (  # noqa: F401
    RUN_SCHEMA,
    append_run,
    append_runs,
    import_array_log,
    read_log,
    timed,
)
from vectorloom.sources.tables import (  # noqa: F401
    read_matrix,
    read_splits,
    shard,
    table,
    with_split,
    write_matrix,
)
