"""What test code is, by rule tables and joins: test methods, frameworks of classes, owners of fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.operators.graph import closure
from suitestat.operators.rules import best_rule

#: Packages that an annotation is imported from.
TEST_ANNOTATIONS = {
    "Test": ("org.junit", "org.junit.jupiter.api", "org.testng.annotations"),
    "ParameterizedTest": ("org.junit.jupiter.params",),
    "TestFactory": ("org.junit.jupiter.api",),
    "RepeatedTest": ("org.junit.jupiter.api",),
}
FIXTURE_ANNOTATIONS = {
    "Before": ("org.junit",),
    "BeforeEach": ("org.junit.jupiter.api",),
    "BeforeAll": ("org.junit.jupiter.api",),
    "BeforeClass": ("org.junit", "org.testng.annotations"),
    "BeforeMethod": ("org.testng.annotations",),
    "BeforeSuite": ("org.testng.annotations",),
    "BeforeTest": ("org.testng.annotations",),
    "BeforeGroups": ("org.testng.annotations",),
    "After": ("org.junit",),
    "AfterEach": ("org.junit.jupiter.api",),
    "AfterAll": ("org.junit.jupiter.api",),
    "AfterClass": ("org.junit", "org.testng.annotations"),
    "AfterMethod": ("org.testng.annotations",),
    "AfterSuite": ("org.testng.annotations",),
    "AfterTest": ("org.testng.annotations",),
    "AfterGroups": ("org.testng.annotations",),
}
SPRING_ANNOTATIONS = {
    "WebMvcTest": ("org.springframework.boot.test.autoconfigure.web.servlet",),
    "AutoConfigureMockMvc": ("org.springframework.boot.test.autoconfigure.web.servlet",),
    "WebFluxTest": ("org.springframework.boot.test.autoconfigure.web.reactive",),
}
#: What an import below a package says of a class.
TESTING_PACKAGES = {
    "org.junit.jupiter": "junit5",
    "org.junit": "junit4",
    "junit.framework": "junit3",
    "org.testng": "testng",
    "org.assertj": "assertj",
    "org.hamcrest": "hamcrest",
    "com.google.common.truth": "google-truth",
    "org.mockito": "mockito",
    "org.easymock": "easymock",
    "org.powermock": "powermock",
    "mockit": "jmockit",
    "org.jmock": "jmock",
    "org.springframework.boot.test": "spring-test",
    "org.springframework.test": "spring-test",
    "io.restassured": "rest-assured",
    "com.jayway.restassured": "rest-assured",
    "com.intuit.karate": "karate",
    "io.karatelabs": "karate",
    "au.com.dius.pact": "pact",
    "org.citrusframework": "citrus",
}
CLIENT_PACKAGES = {
    "org.springframework.test.web.servlet": "mockmvc",
    "org.springframework.test.web.reactive.server": "webtestclient",
    "org.springframework.boot.test.web.client": "test-rest-template",
}
CLIENT_ANNOTATIONS = {"WebMvcTest": "mockmvc", "AutoConfigureMockMvc": "mockmvc", "WebFluxTest": "webtestclient"}


def allowed(spark: SparkSession, *tables: dict[str, tuple[str, ...]]) -> DataFrame:
    """(short_name, package) rows of annotation tables, for rules.import_evidence."""
    return spark.createDataFrame([(name, p) for t in tables for name, ps in t.items() for p in ps], "short_name string, package string")


def frameworks(imports: DataFrame, packages: dict[str, str]) -> DataFrame:
    """SYM-06/07: (class_name, framework) by the longest package of each import; a package stands for itself and for what is below it."""
    rules = imports.sparkSession.createDataFrame([(i, p, f) for i, (p, f) in enumerate(packages.items())], "rule_id int, prefix string, framework string")
    return best_rule(imports, F.broadcast(rules), "path", "class_name").select("class_name", "framework").distinct()  # a fixed list


def sub_frameworks(imports: DataFrame, evidence: DataFrame) -> DataFrame:
    """SYM-07: (class_name, framework): Spring test clients by import, and by the annotations of a class that its imports confirm (evidence: class_name, short_name)."""
    named = imports.sparkSession.createDataFrame(list(CLIENT_ANNOTATIONS.items()), "short_name string, framework string")
    return frameworks(imports, CLIENT_PACKAGES).unionByName(evidence.join(F.broadcast(named), "short_name").select("class_name", "framework")).distinct()


def test_methods(methods: DataFrame, method_annotations: DataFrame, class_annotations: DataFrame, class_frameworks: DataFrame, parents: DataFrame) -> DataFrame:
    """SYM-02: methods with is_test, by a test annotation, by JUnit 3's names, or by TestNG's @Test on the class.

    methods: class_name, method_signature, modifiers, return_type, parameter_count;
    method_annotations (class_name, method_signature, short_name) and class_annotations
    (class_name, short_name) hold those that imports confirm; class_frameworks:
    class_name, framework; parents: class_name, parent.  Null modifiers are none, and
    a null return type isn't void.
    """
    keys = ["class_name", "method_signature"]
    own = method_annotations.groupBy(*keys).agg(F.bool_or(F.col("short_name").isin(*TEST_ANNOTATIONS)).alias("_test"), F.bool_or(F.col("short_name").isin(*FIXTURE_ANNOTATIONS)).alias("_fixture"))
    flag = lambda d, on, name: d.filter(on).select("class_name").distinct().withColumn(name, F.lit(True))
    cls = (
        flag(class_frameworks, F.col("framework") == "junit3", "_junit3")
        .join(flag(class_frameworks, F.col("framework") == "testng", "_testng"), "class_name", "full")
        .join(flag(parents, F.col("parent").endswith("TestCase"), "_case"), "class_name", "full")
        .join(flag(class_annotations, F.col("short_name") == "Test", "_class_test"), "class_name", "full")
    )
    m = methods.join(own, keys, "left").join(cls, "class_name", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    public = F.coalesce(F.array_contains("modifiers", "public"), F.lit(False))
    void = F.coalesce(F.col("return_type") == "void", F.lit(False))
    by_name = yes("_junit3") & yes("_case") & F.col("method_signature").startswith("test") & public & void & (F.coalesce("parameter_count", F.lit(0)) == 0)
    by_class = yes("_testng") & yes("_class_test") & public & ~yes("_fixture")
    return m.select(*methods.columns, (yes("_test") | by_name | by_class).alias("is_test"))


def fixture_owners(edges: DataFrame) -> DataFrame:
    """SYM-38: (child, ancestor, depth, relation): class for itself, super if it is reached by extends alone, else interface.

    edges: class_name, parent, kind (extends or implements).
    """
    supers = closure(edges.filter("kind = 'extends'")).select("child", "ancestor", F.lit(True).alias("_super"))
    relation = F.when(F.col("depth") == 0, "class").when(F.col("_super"), "super").otherwise("interface")
    return closure(edges).join(supers.hint("merge"), ["child", "ancestor"], "left").withColumn("relation", relation).drop("_super")
