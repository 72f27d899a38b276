"""Names, limits, codes, patterns and texts that results depend on."""

# Limits of the issue rules, in percent where not said otherwise.
HIGH_MISSING_PCT = 30.0
MODERATE_MISSING_PCT = 5.0
HIGH_SKEW = 1.0
EXTREME_SKEW = 2.0
OUTLIER_PCT = 1.0
MANY_LEVELS = 50
KEY_UNIQUE_SHARE = 0.9
DOMINANT_PCT = 95.0
MIXED_LOW, MIXED_HIGH = 0.1, 0.9
DUPLICATES_MIN_COLUMNS = 3
SCALE_RATIO = 100.0

# Numbers that stand for missing values, and from which share on.
SENTINEL_CODES = (-1, -9, -99, -999, -9999, 999, 9999, 99999, 999999)
SENTINEL_MIN_PCT = 1.0

# Texts that stand for missing values.
PLACEHOLDERS = ("", "-", "--", "?", "na", "n/a", "nan", "null", "none", "missing", "unknown")

# Patterns of numbers and dates in texts.
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
DECORATION = r"[\s$€£¥₹%]"
DECIMAL_COMMA = r"-?\d{1,3}(?:\.\d{3})+,\d+|-?\d+,\d+"
DATE_SHAPE = r"\d{4}|\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2}\b"

# What a CSV cell may hold for a missing value.
CSV_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CSV_ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
CSV_DELIMITERS = (",", ";", "\t", "|")

# The bounds of the view that may leave the engine.
VIEW_COLUMNS = 40
VIEW_NAMES = 200
VIEW_ISSUES = 8

# Modules that suggested code may not import.
FORBIDDEN_MODULES = (
    "os", "sys", "subprocess", "shutil", "socket", "requests", "urllib", "urllib3", "http", "httpx", "aiohttp", "ftplib", "smtplib", "importlib",
    "pickle", "shelve", "marshal", "joblib", "dill", "ctypes", "multiprocessing", "pathlib", "glob", "tempfile", "builtins", "runpy", "code", "webbrowser",
)
# Functions that suggested code may not call.
FORBIDDEN_CALLS = ("eval", "exec", "compile", "__import__", "open", "input", "breakpoint", "globals", "locals", "vars", "getattr", "setattr", "delattr")
# Methods of data libraries that read or write.
FORBIDDEN_METHODS = (
    "read_csv", "read_table", "read_fwf", "read_excel", "read_json", "read_html", "read_xml", "read_parquet", "read_orc", "read_feather", "read_hdf", "read_pickle", "read_sql", "read_sql_query", "read_sql_table", "read_stata", "read_sas", "read_spss", "read_clipboard",
    "to_csv", "to_excel", "to_json", "to_html", "to_xml", "to_parquet", "to_orc", "to_feather", "to_hdf", "to_pickle", "to_sql", "to_stata", "to_clipboard",
    "load", "loadtxt", "genfromtxt", "fromfile", "save", "savez", "savez_compressed", "savetxt", "tofile", "dump",
)
# Spark's own ways out of a DataFrame, and its readers.
FORBIDDEN_SPARK = (
    "write", "writeStream", "writeTo", "rdd", "_jvm", "_jdf", "_jsc", "saveAsTable", "insertInto", "addFile", "addPyFile", "addArtifact", "foreach", "foreachBatch", "foreachPartition",
    "sparkContext", "toLocalIterator", "collect", "toPandas", "toArrow", "pandas_api", "createDataFrame",
)
FORBIDDEN_READERS = ("read", "readStream", "table", "sql")

# The question that finds the advice for an issue; {type} is the semantic type.
QUESTIONS = {
    "duplicate_rows": "how to detect and remove duplicate rows in a dataset",
    "mixed_feature_scales": "feature scaling standardization vs min-max normalization",
    "constant_column": "zero variance constant features should be dropped before modeling",
    "empty_column": "how to handle columns that are completely empty",
    "high_missing": "how to handle columns with a high percentage of missing {type} values",
    "moderate_missing": "best strategy for imputing missing {type} values",
    "low_missing": "imputing a very small percentage of missing {type} values or dropping those rows",
    "infinite_values": "replacing infinite values in a numeric column with missing values",
    "sentinel_values": "numeric placeholder codes like -999 or 99999 that stand for missing values",
    "high_skew": "log or power transform for skewed numeric features",
    "outliers": "detecting outliers with the interquartile range and clipping extreme values",
    "identifier_like": "dropping high cardinality identifier columns before modeling",
    "numeric_stored_as_text": "converting object dtype columns to numeric dtypes",
    "datetime_stored_as_text": "parsing datetime columns and extracting temporal features",
    "mixed_types": "cleaning columns with inconsistent mixed data types",
    "high_cardinality": "encoding high cardinality categorical features target or frequency encoding",
    "needs_encoding": "one hot encoding vs ordinal encoding for categorical features",
    "imbalanced_category": "handling severely imbalanced or near constant categorical features",
}

# Chunk sizes in characters and the retrieval cutoff.
CHUNK_TARGET, CHUNK_MAX, CHUNK_TAIL = 600, 900, 80
SIMILARITY_CUTOFF = 0.45
