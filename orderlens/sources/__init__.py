from orderlens.sources.bucketed import bucket_load, read_bucketed, write_bucketed
from orderlens.sources.catalog import publish, publish_classifiers, run_sql
from orderlens.sources.files import SCHEMAS, load_csv, read_csv, read_ordered, read_parquet, write_ordered, write_result
from orderlens.sources.scratch import remove_run, ship_package, store
from orderlens.sources.statistics import analyze, save_analyzed, statistics_of

__all__ = ["SCHEMAS", "analyze", "bucket_load", "load_csv", "publish", "publish_classifiers", "read_bucketed", "read_csv", "read_ordered",
           "read_parquet", "remove_run", "run_sql", "save_analyzed", "ship_package", "statistics_of", "store", "write_bucketed", "write_ordered", "write_result"]
