"""Input views over the driver tables, one SQL text for Spark and for the oracle engine."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "sensor": """
        select event_id, user_id as device_id, ts as recorded_at, value as soil,
               cast(15 + {K} % 25 as double) as temp_c, cast(40 + {K} % 61 as double) as rh,
               {K} % 10 <> 0 as valid, {K} * 60 as age_sec, event_type as sig1, {K} % 2 as sig2
        from [events]""",
    "daily": """
        select n.n_regionkey as province, cast(l_shipdate as date) as day,
               greatest(0.0, sum(l_quantity) - 60.0) as rain_mm, 18 + 40 * avg(l_discount) as t_min,
               24 + 40 * avg(l_discount) + 100 * avg(l_tax) as t_max, 50 + min(l_quantity) as rh,
               sum(l_extendedprice) / 10000 as solar
        from [lineitem] join [supplier] on l_suppkey = s_suppkey join [nation] n on s_nationkey = n_nationkey
        group by n.n_regionkey, cast(l_shipdate as date)""",
    "year": """
        select c_nationkey as province, year(o_orderdate) as year_ce, sum(o_totalprice) / 1000 as production,
               count(*) as area, sum(o_totalprice) / count(*) as yield_v
        from [orders] join [customer] on o_custkey = c_custkey
        group by c_nationkey, year(o_orderdate)""",
    "month": """
        select c_nationkey as province, year(o_orderdate) as year_ce, month(o_orderdate) as month,
               sum(o_totalprice) / 1000 as tonnes
        from [orders] join [customer] on o_custkey = c_custkey
        group by c_nationkey, year(o_orderdate), month(o_orderdate)""",
    "ord": """
        select o_orderkey as doc_id, o_custkey % 25 as province, cast(o_orderdate as date) as start_date,
               cast(max(l_shipdate) as date) as end_date, max(o_orderpriority) as state, max(o_totalprice) as v
        from [orders] join [lineitem] on o_orderkey = l_orderkey
        group by o_orderkey, o_custkey % 25, cast(o_orderdate as date)""",
    "vint": """
        select o_custkey % 5 as location, o_orderkey as issue_id, o_orderpriority as source, o_orderdate as issued,
               o_orderdate + (o_orderkey % 12) * interval '1' hour as received,
               o_orderdate + h * interval '1' hour as valid, cast(10 + (o_orderkey + h) % 25 as double) as temp_c,
               cast((o_orderkey * h) % 8 as double) as rain_mm
        from [orders] {H}
        where (o_orderkey + h) % 7 <> 0""",
    "part_area": """
        select s_nationkey as province, p_brand as cls, p_type as code, sum(p_size) as area, count(*) as n
        from [lineitem] join [part] on l_partkey = p_partkey join [supplier] on l_suppkey = s_suppkey
        group by s_nationkey, p_brand, p_type""",
    "pts": """
        select vec_id as point_id, label as province, round(101 + 3 * cast({E}(embedding, 1) as double), 4) as lon,
               round(13 + 3 * cast({E}(embedding, 2) as double), 4) as lat, vec_id % 4 as source
        from [embeddings]""",
    "pix": "select vec_id, {T} as px from [embeddings]",
    "log": """
        select conv_id as record_id, turn as version, role as owner, cast(length(text) as bigint) as v
        from [conversations]""",
    # Fixture only: the operators themselves never fill a missing day.
    "daily_full": """
        select g.province, g.day, coalesce(d.rain_mm, 0.0) as rain_mm, coalesce(d.t_min, 20.0) as t_min,
               coalesce(d.t_max, 30.0) as t_max, coalesce(d.rh, 60.0) as rh, coalesce(d.solar, 15.0) as solar
        from (select province, {G} as day
              from (select distinct province from [daily]) p
              cross join (select min(day) lo, max(day) hi from [daily]) r) g
        left join [daily] d on g.province = d.province and g.day = d.day""",
}

NEEDS = {"daily_full": ("daily",)}

SPARK_FORMS = {
    "{K}": "cast(get_json_object(props,'$.k') as bigint)",
    "{E}": "element_at",
    "{T}": "transform(embedding, x -> cast(round(cast(x as double)*10000) as int))",
    "{G}": "explode(sequence(lo, hi))",
    "{H}": "lateral view explode(array(1, 2, 3, 4, 5, 6)) x as h",
}
ORACLE_FORMS = {
    "{K}": "cast(json_extract_string(props,'$.k') as bigint)",
    "{E}": "list_extract",
    "{T}": "list_transform(embedding, lambda x: cast(round(cast(x as double)*10000) as integer))",
    "{G}": "cast(unnest(generate_series(lo, hi, interval 1 day)) as date)",
    "{H}": "cross join (select * from (values (1),(2),(3),(4),(5),(6)) v(h)) x",
}


def _fill(text: str, forms: dict[str, str], table) -> str:
    for key, value in forms.items():
        text = text.replace(key, value)
    for name in (*BASE_TABLES, *VIEWS):
        text = text.replace(f"[{name}]", table(name))
    return text


def oracle_with(names: tuple[str, ...]) -> str:
    """The WITH list that defines the named views for the oracle engine."""
    ordered: list[str] = []
    for name in names:
        for item in (*NEEDS.get(name, ()), name):
            if item not in ordered:
                ordered.append(item)
    return ",\n".join(f"{n} as ({_fill(VIEWS[n], ORACLE_FORMS, str)})" for n in ordered)


class Tables:
    """Lazy access to the driver tables and the views above for one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        used = {n: None for n in (*BASE_TABLES, *VIEWS) if f"[{n}]" in VIEWS[name]}
        frames = {n: getattr(self, n) if n in VIEWS else self.base(n) for n in used}
        return self.spark.sql(_fill(VIEWS[name], SPARK_FORMS, lambda n: "{" + n + "}"), **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            frame = self._view(name)
        elif name in BASE_TABLES:
            frame = self.base(name)
        else:
            raise AttributeError(name)
        self.__dict__[name] = frame
        return frame
