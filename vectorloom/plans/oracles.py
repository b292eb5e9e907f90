"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from vectorloom.operators.permutation import LOW, MULTIPLIER, round_keys

_E = """e AS (
  SELECT vec_id, embedding, label, CAST(label < 7 AS INT) AS label2,
         CASE WHEN vec_id % 10 <= 6 THEN 'train' WHEN vec_id % 10 <= 8 THEN 'test'
              ELSE 'validation' END AS split
  FROM embeddings)"""

_M = f"""{_E}, m AS (
  SELECT vec_id, split, list_concat(
           list_transform(embedding, lambda v: CAST(v AS DOUBLE)),
           list_transform(range(0, 10), lambda i: CAST(i = label AS DOUBLE))) AS matrix
  FROM e)"""

_X = f"""{_E}, x AS (
  SELECT vec_id, label, label2, split, unnest(range(len(embedding)))::INT AS pos,
         unnest(embedding)::DOUBLE AS v
  FROM e)"""

_P = f"""{_X}, p AS (
  SELECT pos, avg(v) AS mean, stddev_pop(v) AS std FROM x WHERE split = 'train' GROUP BY pos)"""

_TEXT = "array_to_string(list_transform({}, lambda h: CAST(CAST(h AS BIGINT) AS VARCHAR)), ',')"


def _histogram(positions: str, common: bool = False) -> str:
    groups = "pos" if common else "pos, label2"
    return f"""WITH {_P},
    c AS (SELECT pos, label2, v FROM x WHERE split = 'train' AND pos IN ({positions})),
    r AS (SELECT {groups}, min(v) AS lo, max(v) AS hi FROM c GROUP BY {groups}),
    b AS (SELECT pos, label2, least(floor((v - lo) * 20 / (hi - lo)), 19)::INT AS bin,
                 count(*) AS n
          FROM c JOIN r USING ({groups}) GROUP BY ALL),
    g AS (SELECT pos, label2, lo, hi, unnest(range(20))::INT AS bin
          FROM (SELECT DISTINCT pos, label2 FROM c) JOIN r USING ({groups}))
    SELECT pos, label2, bin, round(lo + bin * (hi - lo) / 20, 8) + 0.0 AS edge,
           coalesce(n, 0) AS n
    FROM g LEFT JOIN b USING (pos, label2, bin)"""


def _boxes(values: str, digits: int) -> str:
    """Box plots of `values(pos, v)`, continued by a SELECT."""
    return f"""c AS ({values}),
    q AS (SELECT pos, count(*) AS total, quantile_cont(v, 0.25) AS q1, median(v) AS med,
                 quantile_cont(v, 0.75) AS q3 FROM c GROUP BY pos),
    f AS (SELECT c.pos, v, total, q1, med, q3,
                 v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM c JOIN q ON c.pos = q.pos),
    s AS (SELECT pos, total, round(q1, {digits}) + 0.0 AS q1, round(med, {digits}) + 0.0 AS median,
                 round(q3, {digits}) + 0.0 AS q3,
                 round(least(min(CASE WHEN inside THEN v END), q1), {digits}) + 0.0 AS whisker_low,
                 round(greatest(max(CASE WHEN inside THEN v END), q3), {digits}) + 0.0
                   AS whisker_high,
                 count(*) FILTER (NOT inside) AS outliers
          FROM f GROUP BY pos, total, f.q1, med, f.q3)"""


_TOP = "SELECT pos FROM p ORDER BY {0} DESC, pos DESC LIMIT {1}"


def _top_values(statistic: str) -> str:
    top = _TOP.format(statistic, 10)
    return f"SELECT pos, v FROM x WHERE split = 'train' AND pos IN ({top})"


_MNB = f"""{_E}, w AS (
  SELECT vec_id, label, split, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS z FROM e),
x AS (
  SELECT vec_id, label, split, unnest(range(len(z)))::INT AS pos, unnest(z) / list_sum(z) AS v
  FROM w),
pr AS (SELECT label, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS pi
       FROM e WHERE split = 'train' GROUP BY label),
st AS (SELECT label, pos, ln((sum(v) + 1) / (sum(sum(v)) OVER (PARTITION BY label)
              + count(*) OVER (PARTITION BY label))) AS theta
       FROM x WHERE split = 'train' GROUP BY label, pos)"""


def _gnb(rows: str, fitted: str) -> str:
    """Gaussian Naive Bayes on `rows(id, label, split, pos, v)`; fits where `fitted` holds."""
    return f"""x AS ({rows}),
    ep AS (SELECT 1e-9 * max(sv) AS ep FROM (
             SELECT var_samp(v) AS sv FROM x WHERE {fitted} GROUP BY pos)),
    st AS (SELECT label, pos, avg(v) AS mu, var_pop(v) + (SELECT ep FROM ep) AS s2
           FROM x WHERE {fitted} GROUP BY label, pos),
    pr AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS pi
           FROM x WHERE {fitted} AND pos = 0 GROUP BY label),
    sc AS (SELECT x.id, x.label, x.split, st.label AS k,
                  sum(-0.5 * ln(2 * pi() * s2) - (v - mu) * (v - mu) / (2 * s2))
                    + any_value(pr.pi) AS score
           FROM x JOIN st ON x.pos = st.pos JOIN pr ON st.label = pr.label
           GROUP BY x.id, x.label, x.split, st.label),
    pd AS (SELECT id, label, split, arg_max(k, score)::INT AS prediction FROM sc
           GROUP BY id, label, split)"""


_GNB = f"""WITH {_E}, {_gnb(
    "SELECT vec_id AS id, label, split, unnest(range(len(embedding)))::INT AS pos,"
    " unnest(embedding)::DOUBLE AS v FROM e", "split = 'train'")}"""

_LINES = """l AS (
  SELECT row_number() OVER () AS id, l_returnflag AS class_name,
         [l_quantity, l_extendedprice, l_discount, l_tax] AS f,
         (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INT AS label
  FROM lineitem)"""

_SCORES = """SELECT split, sum(n) AS n, sum(hits) / sum(n) AS accuracy, max(n) / sum(n) AS majority
  FROM (SELECT split, label, count(*) AS n, count(*) FILTER (prediction = label) AS hits
        FROM pd GROUP BY split, label) GROUP BY split"""


def _dot(width: int, output: int, value: str) -> str:
    """Sum over j of the fixed weight and `value` (which names the position j)."""
    weight = f"((7 * j + 3 * {output}) % 5 - 2) / 4.0::DOUBLE"
    return f"list_sum(list_transform(range(0, {width}), lambda j: {weight} * {value}))"


_PIXEL = "floor((CAST(embedding[{0} + 1] AS DOUBLE) + 1) * 127.5)"

def _epochs(seed: int, epochs: int) -> str:
    """Keys of ids below 2^32 in each epoch, one step of the permutation after the other."""
    sql = "SELECT vec_id, label, " + ", ".join(f"0::BIGINT AS l{e}, vec_id AS r{e}" for e in range(epochs))
    sql += " FROM embeddings"
    for keys in zip(*(round_keys(seed, e) for e in range(epochs))):
        mixed = [f"(r{e} * {MULTIPLIER} + {key}) & {LOW} AS m{e}" for e, key in enumerate(keys)]
        turned = [f"r{e} AS l{e}, xor(l{e}, xor(m{e}, m{e} >> 15)) AS r{e}" for e in range(epochs)]
        sql = f"SELECT vec_id, label, {', '.join(turned)} FROM (SELECT *, {', '.join(mixed)} FROM ({sql}))"
    # A key is the two halves as one signed number.
    key = "(CASE WHEN l{0} >= 2147483648 THEN l{0} - 4294967296 ELSE l{0} END) * 4294967296 + r{0} AS key_{0}"
    return f"SELECT vec_id, label, {', '.join(key.format(e) for e in range(epochs))} FROM ({sql})"


# A 2:1 reduction with half-pixel centres takes the mean of each 2 x 2 square.
_SQUARE = "({}) / 4".format(
    " + ".join(_PIXEL.format(f"(16 * (i // 4) + 2 * (i % 4) + {d})") for d in (0, 1, 8, 9))
)

_HIDDEN = ", ".join(
    f"greatest({_dot(64, o, 'CAST(embedding[j + 1] AS DOUBLE)')}, 0)" for o in range(6)
)
_OUTPUT = ", ".join(_dot(6, o, "h[j + 1]") for o in range(5))

ORACLES: dict[str, str] = {
    "matrix_scan_split": f"""WITH {_E}
        SELECT split, count(*) AS n_rows, min(len(embedding))::INT AS narrowest,
               max(len(embedding))::INT AS widest, sum(label)::BIGINT AS label_sum
        FROM e GROUP BY split""",
    "matrix_round_trip": f"""WITH {_E}
        SELECT vec_id, label,
               round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) + 0.0
                 AS total
        FROM e WHERE split = 'test'""",
    "matrix_round_trip_by_split": f"""WITH {_E}
        SELECT split, vec_id, label, len(embedding)::INT AS width,
               round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) + 0.0
                 AS total
        FROM e""",
    "npy_scan": """SELECT vec_id, vec_id % 2 = 0 AS single, unnest(range(1, 66))::INT AS pos,
          round(unnest(list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), CAST(label AS DOUBLE))), 6) + 0.0
            AS value FROM embeddings""",
    "npy_headers": """SELECT 'f' AS kind, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 8 END::BIGINT AS item_bytes,
          66::BIGINT AS width, count(*)::BIGINT AS n_rows FROM embeddings GROUP BY ALL""",
    "shuffled_epochs": _epochs(17, 3),
    "shuffled_rows": "SELECT vec_id, label FROM embeddings",
    "feature_slice": f"""WITH {_M}, s AS (SELECT vec_id, matrix[1:len(matrix) - 10] AS f FROM m)
        SELECT vec_id, len(f)::INT AS n_features, f[1] AS first_value, f[-1] AS last_value,
               round(list_sum(f), 6) + 0.0 AS total FROM s""",
    "label_slice_argmax": f"""WITH {_M}, s AS (SELECT vec_id, matrix[-10:] AS y FROM m)
        SELECT vec_id, list_position(y, list_max(y))::BIGINT - 1 AS label_index FROM s""",
    "onehot_index": f"""SELECT vec_id,
        {_TEXT.format("list_transform(range(0, 10), lambda i: i = label)")} AS onehot
        FROM embeddings""",
    "onehot_class_name": f"""WITH c AS (
          SELECT list_sort(list(DISTINCT l_returnflag)) AS names FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_returnflag,
               {_TEXT.format("list_transform(names, lambda n: n = l_returnflag)")} AS onehot
        FROM lineitem CROSS JOIN c""",
    "path_parent_label": """SELECT page_id,
        list_extract(string_split(url, '/'), -2) AS class_name FROM pages""",
    "class_list": """SELECT DISTINCT l_returnflag AS class_name FROM lineitem
        WHERE l_returnflag IS NOT NULL""",
    "column_pick": """SELECT vec_id, embedding[1]::DOUBLE AS c0, embedding[8]::DOUBLE AS c1,
        embedding[64]::DOUBLE AS c2 FROM embeddings""",
    "features_onehot_concat": f"""WITH {_M}
        SELECT vec_id, len(matrix)::INT AS width, matrix[1] AS first_value,
               {_TEXT.format("matrix[-10:]")} AS onehot FROM m""",
    "feature_label_join": """SELECT doc_id, lang, source, n_chars, quality, toxic
        FROM documents JOIN labels USING (doc_id)""",
    "feature_label_unmatched": """SELECT doc_id, lang, n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "class_mask": f"WITH {_E} SELECT vec_id, label, label2 FROM e WHERE label2 = 0",
    "elapsed_units": """SELECT event_id, value AS seconds, round(value / 60.0, 9) + 0.0 AS minutes,
        round(value / 3600.0, 9) + 0.0 AS hours FROM events""",
    "shifted_timestamp": """SELECT event_id,
        strftime(ts - INTERVAL 5 HOURS, '%Y-%m-%dT%H:%M:%S.%f') || '-05:00' AS local_iso
        FROM events""",
    "run_mode_label": """SELECT event_id,
        CASE event_type WHEN 'click' THEN 'Cluster' WHEN 'view' THEN 'CPU'
             WHEN 'purchase' THEN 'GPU' ELSE 'Other' END AS mode,
        CASE event_type WHEN 'click' THEN 2 ELSE 0 END AS slots FROM events""",
    "run_log_round_trip": """SELECT
        CASE event_type WHEN 'click' THEN 'Cluster' WHEN 'view' THEN 'CPU'
             WHEN 'purchase' THEN 'GPU' ELSE 'Other' END AS mode,
        event_type AS method, value AS elapsed_seconds,
        round(value / 60.0, 9) + 0.0 AS elapsed_minutes FROM events""",
    "run_log_all_columns": """SELECT
        CASE event_type WHEN 'click' THEN 'Cluster' WHEN 'view' THEN 'CPU'
             WHEN 'purchase' THEN 'GPU' ELSE 'Other' END AS mode,
        event_type AS method, epoch_us(ts) AS started_micros, length(event_type)::INT AS epochs,
        (event_id % 7)::INT AS steps_per_epoch, value AS elapsed_seconds,
        round(value / 60.0, 9) + 0.0 AS elapsed_minutes, round(value / 3600.0, 9) + 0.0 AS elapsed_hours,
        CASE event_type WHEN 'click' THEN 2 ELSE 0 END::INT AS slots, (event_id % 5)::INT AS parallelism,
        round(value / 1000.0, 9) + 0.0 AS accuracy,
        CASE WHEN event_id % 3 > 0 THEN round(value / 1000.0, 9) + 0.0 END AS first_accuracy,
        CASE WHEN event_id % 3 > 0 THEN round(value / 2000.0, 9) + 0.0 END AS second_accuracy
        FROM events""",
    "column_means": f"WITH {_P} SELECT pos, round(mean, 8) + 0.0 AS mean FROM p",
    "column_stddev_pop": f"WITH {_P} SELECT pos, round(std, 8) + 0.0 AS std FROM p",
    "rank_by_mean": f"""WITH {_P}
        SELECT pos, row_number() OVER (ORDER BY mean DESC, pos DESC)::INT AS rank FROM p""",
    "rank_by_std": f"""WITH {_P}
        SELECT pos, row_number() OVER (ORDER BY std, pos)::INT AS rank FROM p""",
    "topk_columns": f"""WITH {_P}
        SELECT pos, round(mean, 8) + 0.0 AS mean FROM p
        WHERE pos IN ({_TOP.format("mean", 10)})""",
    "class_histogram": _histogram("0"),
    "class_histogram_common_range": _histogram("0, 5", common=True),
    "top3_class_histograms": _histogram(_TOP.format("mean", 3)),
    "boxplot_stats": f"WITH {_P}, {_boxes(_top_values('mean'), 8)} SELECT * FROM s",
    "boxplot_stats_by_std": f"WITH {_P}, {_boxes(_top_values('std'), 8)} SELECT * FROM s",
    "boxplot_outliers": f"""WITH {_P}, {_boxes(_top_values('mean'), 8)}
        SELECT pos, round(v, 8) + 0.0 AS value, count(*) AS n FROM f WHERE NOT inside
        GROUP BY pos, v""",
    "lineitem_profile": f"""WITH {_LINES}, x AS (
          SELECT class_name, unnest(range(4))::INT AS pos, unnest(f) AS v FROM l)
        SELECT class_name, pos, count(*) AS n, round(avg(v), 5) + 0.0 AS mean,
               round(stddev_pop(v), 5) + 0.0 AS std, min(v) AS lo, max(v) AS hi
        FROM x GROUP BY class_name, pos""",
    "lineitem_boxplots": f"""WITH {_LINES},
        {_boxes("SELECT unnest(range(4))::INT AS pos, unnest(f) AS v FROM l", 5)}
        SELECT * FROM s""",
    "image_resize": f"""WITH i AS (
          SELECT vec_id, embedding, unnest(range(16))::INT AS i FROM embeddings)
        SELECT vec_id, i AS pos, {_SQUARE} AS value FROM i""",
    "image_resize_colour": """WITH px AS (
          SELECT vec_id, list_transform(embedding[1:54], lambda v:
            floor((CAST(v AS DOUBLE) + 1.0) * 127.5)) AS px FROM embeddings),
        s AS (SELECT * FROM (VALUES (3, 1), (4, 2), (12, 6)) s(h, w)),
        y AS (SELECT h, w, y, greatest(least((y + 0.5::DOUBLE) * 6 / h - 0.5, 5), 0) AS at
              FROM s, unnest(range(h)) AS u(y)),
        x AS (SELECT h, w, x, greatest(least((x + 0.5::DOUBLE) * 3 / w - 0.5, 2), 0) AS at
              FROM s, unnest(range(w)) AS u(x)),
        g AS (SELECT y.h, y.w, c, (y * y.w + x) * 3 + c AS pos,
                floor(y.at)::INT AS top, least(floor(y.at)::INT + 1, 5) AS bottom, y.at - floor(y.at) AS down,
                floor(x.at)::INT AS l, least(floor(x.at)::INT + 1, 2) AS r, x.at - floor(x.at) AS along
              FROM y JOIN x ON y.h = x.h AND y.w = x.w, unnest(range(3)) AS u(c))
        SELECT vec_id, h || 'x' || w AS size, pos::INT AS pos,
          (px[(top * 3 + l) * 3 + 3 - c] * (1 - along) + px[(top * 3 + r) * 3 + 3 - c] * along) * (1 - down)
          + (px[(bottom * 3 + l) * 3 + 3 - c] * (1 - along) + px[(bottom * 3 + r) * 3 + 3 - c] * along) * down AS value
        FROM px, g""",
    "image_label_rows": f"""WITH i AS (
          SELECT vec_id, label, list_sum(list_transform(range(0, 16), lambda i: {_SQUARE})) * 3
                   AS total FROM embeddings),
        c AS (SELECT list_sort(list(DISTINCT 'class-' || label)) AS names FROM embeddings)
        SELECT 'images/class-' || label || '/' || vec_id || '.png' AS path,
               round(total, 6) + 0.0 AS total,
               {_TEXT.format("list_transform(names, lambda n: n = 'class-' || label)")} AS onehot
        FROM i CROSS JOIN c""",
    "image_featurise": f"""WITH i AS (
          SELECT vec_id, list_transform(range(0, 16), lambda i: {_SQUARE}) AS px FROM embeddings)
        SELECT vec_id, {_dot(48, 0, "px[j // 3 + 1]")} AS f0, {_dot(48, 1, "px[j // 3 + 1]")} AS f1
        FROM i""",
    "linear_featurise": "SELECT vec_id, "
    + ", ".join(
        f"round({_dot(64, o, 'CAST(embedding[j + 1] AS DOUBLE)')}, 6) + 0.0 AS f{o}" for o in range(4)
    )
    + " FROM embeddings",
    "mnb_parameters": f"""WITH {_MNB}
        SELECT label, pos, round(pi, 8) + 0.0 AS pi, round(theta, 8) + 0.0 AS theta
        FROM st JOIN pr USING (label)""",
    "mnb_predict": f"""WITH {_MNB}, sc AS (
          SELECT vec_id, x.label, st.label AS k, sum(v * theta) + any_value(pi) AS score
          FROM x JOIN st ON x.pos = st.pos JOIN pr ON st.label = pr.label
          GROUP BY vec_id, x.label, st.label)
        SELECT vec_id, label, arg_max(k, score)::INT AS prediction FROM sc GROUP BY vec_id, label""",
    "gnb_parameters": f"""{_GNB}
        SELECT label, pos, round(pi, 8) + 0.0 AS pi, round(mu, 8) + 0.0 AS theta,
               round(s2, 8) + 0.0 AS sigma FROM st JOIN pr USING (label)""",
    "gnb_predict": f"{_GNB} SELECT id AS vec_id, label, prediction FROM pd",
    "lr_stationarity": f"""WITH {_X}
        SELECT c.label AS class, pos, 0.0::DOUBLE AS slope
        FROM (SELECT DISTINCT pos FROM x) CROSS JOIN (SELECT DISTINCT label FROM x) c""",
    "relu_mlp_forward": f"""WITH h AS (
          SELECT vec_id, [{_HIDDEN}] AS h FROM embeddings),
        z AS (SELECT vec_id, [{_OUTPUT}] AS z FROM h)
        SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS prediction,
               round(1 / list_sum(list_transform(z, lambda s: exp(s - list_max(z)))), 6) + 0.0
                 AS probability FROM z""",
    "lineitem_gnb_confusion": f"""WITH {_LINES}, {_gnb(
        "SELECT id, label, 'train' AS split, unnest(range(4))::INT AS pos, unnest(f) AS v FROM l",
        "true")}
        SELECT label, prediction, count(*) AS n FROM pd GROUP BY label, prediction""",
    "accuracy_by_split": f"""{_GNB}
        SELECT split, n::BIGINT AS n, round(accuracy, 6) + 0.0 AS accuracy,
               round(majority, 6) + 0.0 AS majority_share FROM ({_SCORES})""",
    "accuracy_percent_text": f"""{_GNB}
        SELECT split, printf('%.2f%%', accuracy * 100) AS accuracy_text FROM ({_SCORES})""",
    "confusion_counts": f"""{_GNB}
        SELECT label, prediction, count(*) AS n FROM pd GROUP BY label, prediction""",
    "log_loss": f"""{_GNB},
        ls AS (SELECT id, split, max(score) FILTER (k = label) AS own, max(score) AS top
               FROM sc GROUP BY id, split),
        nm AS (SELECT sc.id, any_value(own - top) AS gap, sum(exp(score - top)) AS total
               FROM sc JOIN ls ON sc.id = ls.id GROUP BY sc.id)
        SELECT pd.split, count(*) AS n,
               round(avg(-ln(greatest(exp(gap) / total, 1e-15))), 6) + 0.0 AS log_loss,
               round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0
                 AS accuracy
        FROM pd JOIN nm ON pd.id = nm.id GROUP BY pd.split""",
    "majority_baseline": """WITH c AS (
          SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)
        SELECT sum(n)::BIGINT AS n,
               (SELECT quality FROM c ORDER BY n DESC, quality LIMIT 1) AS majority_label,
               round(max(n) / sum(n), 6) + 0.0 AS majority_share FROM c""",
    "stratified_folds": """SELECT vec_id, label,
        (ntile(3) OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS fold FROM embeddings""",
    "fold_majority_mean": f"""WITH {_E},
        t AS (SELECT label2, (vec_id % 3)::INT AS fold FROM e WHERE split = 'train'),
        g AS (SELECT f.fold, t.label2, count(*) AS n
              FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY ALL),
        b AS (SELECT fold, arg_min(label2, (-n, label2)) AS best FROM g GROUP BY fold),
        a AS (SELECT t.fold, avg(CASE WHEN label2 = best THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
              FROM t JOIN b ON t.fold = b.fold GROUP BY t.fold)
        SELECT count(*) AS n_folds, round(avg(accuracy), 6) + 0.0 AS mean_accuracy FROM a""",
}
