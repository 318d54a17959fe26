"""What tests ask of physical plans."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def largest_method(df) -> int:
    """Bytes of the largest method that is generated for a plan; the JVM compiles up to 8,000."""
    jvm = df.sparkSession.sparkContext._jvm
    debug = getattr(getattr(jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    sizes, parts = [0], found.iterator()
    while parts.hasNext():
        sizes.append(parts.next()._3().maxMethodCodeSize())
    return max(sizes)
