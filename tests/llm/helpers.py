import duckdb


def duck_rows(sql, sf_dir, tables, cols):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=repr)


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


ODD = [(9001, None), (9002, ""), (9003, "a b"), (9004, " \n\t "), (None, "no id here " * 30), (None, None)]


def frame(spark, rows):
    """With extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "tag": F.lit("y"), "blob": F.lit(1), "n": F.lit(2), "h": F.lit(3), "host": F.lit("z")})
