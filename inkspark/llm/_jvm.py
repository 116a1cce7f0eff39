"""The id coder as functions of Spark's JVM: compiled once a session by the Janino that Spark ships, sent as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import BinaryType

_UDF = """package inkspark;
public class {0} implements org.apache.spark.sql.api.java.UDF1 {{
    public Object call(Object x) {{ return x == null ? null : IdCoder.{1}((byte[]) x); }}
}}
"""
#: SQL names of the functions: class and method
FUNCTIONS = {"inkspark_encode_ids": ("EncodeIds", "encode"), "inkspark_decode_ids": ("DecodeIds", "decode")}
_SENT: dict[str, str] = {}


def _jar(spark: SparkSession) -> str:
    jvm = spark.sparkContext._jvm
    source = (Path(__file__).parent / "idcoder.java").read_text()
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source + "".join(_UDF.format(*x).split("\n", 1)[1] for x in FUNCTIONS.values()))
    path = f"{tempfile.mkdtemp(prefix='inkspark-')}/idcoder.jar"
    codes = compiler.getBytecodes()
    with zipfile.ZipFile(path, "w") as out:
        for name in list(codes):
            out.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
    return path


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session."""
    session = f"{spark.sparkContext.applicationId} {spark._jsparkSession.sessionUUID()}"
    if session not in _SENT:
        path = _jar(spark)
        spark.sql(f"ADD JAR '{path}'")
        loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        binary = spark._jsparkSession.parseDataType(BinaryType().json())
        for name, (kind, _) in FUNCTIONS.items():  # registered as objects, since Janino leaves out the types that go by names
            spark._jsparkSession.udf().register(name, loader.loadClass(f"inkspark.{kind}").getDeclaredConstructors()[0].newInstance(None), binary)
        _SENT[session] = path
