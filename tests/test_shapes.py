"""Rules over shapes of Python code, and fact ids of several repositories."""

import pytest
from factloom import rules  # noqa: F401  registers the catalog
from factloom.plans import engine
from factloom.sources import python_source

SOURCE = '''
import numba
from numba import cuda
from app.deep.inner import Thing

IGNORE_DIRECTORIES = [".git", "node_modules/", "*/build"]
COLOURS = [("red", 1), ("green", 2)]


@cuda.jit
def kernel(a):
    i = cuda.grid(1)
    if a[0]:
        cuda.syncthreads()
    return a[i]


def launch(a):
    kernel[1, 32](a)
    kernel[1, 32, stream](a)


def fill(xs):
    seen = set()
    for x in xs:
        if x:
            seen.add(x)
    allowed = [1, 2, 3]
    return seen, xs in allowed


def scale(x: "Tensor", y: Tensor) -> Tensor:
    """Scales a tensor."""
    return x


def _helper(a):
    b = a
    return b


class Colour(StrEnum):
    RED = "r"
    BLUE = "b"


NAMES = {Colour.RED: 1, Colour.BLUE: 2}


class Item(BaseModel):
    name: str
    sizes: tuple[int, ...]
    left: int | None = None
    right: int | None = None

    @model_validator(mode="after")
    def one(self):
        if self.name == "":
            raise ValueError
        return self

    @model_validator(mode="after")
    def either(self):
        if self.left is None and self.right is None:
            raise ValueError
        return self

    @field_validator("name")
    def short(cls, value):
        if value < 3:
            raise ValueError
        return value


class Loose(FrozenFlexModel):
    pass


class Other(TableModel):
    a: int


class FooContent:
    pass


class FooKind:
    pass


class Plain:
    def __init__(self, a, b, c=1):
        if a:
            raise ValueError
        self.a = a
        self.b = b
        self.c = c
        self.size = self.part.size

    @classmethod
    def make(cls):
        return cls(1, 2)

    @staticmethod
    def build():
        return Plain.make()

    def used(self):
        return self.inner() + _helper(1)

    def inner(self):
        return {"a": self.a, "b": self.b, "c": self.c, "size": self.size}


class Csv(Registered):
    name = "csv"


later = lambda x: (x, x)


def query(session, x):
    f = lambda y: [y]
    session.execute(select(A)).scalars()
    session.exec(select(A)).scalars()
    session.exec(select(A).where(A.id == x)).first()
    return isinstance(x, dict), Colour.RED.value


@pytest.mark.parametrize("n", make_cases())
async def test_async(n):
    assert n
'''
WANT = {
    "ALL-CONF0001": 1, "ALL-FUNC0003": 1, "PY-CLAS0001": 1, "PY-CLAS0002": 2, "PY-CLAS0004": 1, "PY-CLAS0009": 1, "PY-COLL0002": 1, "PY-COLL0003": 1, "PY-COMP0002": 1, "PY-DOCU0002": 1, "PY-ENUM0002": 1,
    "PY-ENUM0003": 0, "PY-ENUM0005": 1, "PY-INTE0001": 1, "PY-MODE0001": 0, "PY-MODE0003": 1, "PY-MODE0004": 1, "PY-NAMI0002": 1, "PY-NUMB0001": 1, "PY-NUMB0002": 1, "PY-NUMB0003": 1, "PY-NUMB0006": 1,
    "PY-PYDA0001": 1, "PY-PYDA0002": 1, "PY-PYDA0005": 1, "PY-PYDA0006": 1, "PY-PYDA0007": 1, "PY-PYDA0008": 1, "PY-SQLA0003": 1, "PY-SQLA0004": 1, "PY-SQLA0005": 1, "PY-TEST0010": 1, "PY-TEST0018": 1,
}


def files(spark, *rows):
    return spark.createDataFrame([(k, *r, None) for k, r in enumerate(rows)], "file_id long, repository string, path string, text string, ingested_at timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    return python_source.tables(files(spark, ("o/a", "src/shapes.py", SOURCE)))


@pytest.mark.parametrize("id", sorted(WANT))
def test_rule(tables, id):
    result = engine.evaluate(engine.CATALOG[id], tables)
    assert [r.integer_value for r in result.values.collect()] == [WANT[id]]
    assert result.findings.count() == WANT[id]


def test_imports_and_models_of_packages(spark):
    made = python_source.tables(files(spark, ("o/a", "app/deep/__init__.py", "from .inner import Thing\n__all__ = ['Thing']\n"), ("o/a", "use.py", "from app.deep.inner import Thing\n"), ("o/a", "app/models/a.py", "class A(BaseModel): pass\nclass B(BaseModel): pass\n"), ("o/a", "app/models/b.py", "class A(BaseModel): pass\n")))
    value = lambda id: {r.path: r.integer_value for r in engine.evaluate(engine.CATALOG[id], made).values.where("integer_value > 0").collect()}
    assert value("PY-IMPO0006") == {"use.py": 1} and value("PY-MODE0001") == {"app/models/a.py": 1}


def test_equal_paths_of_two_repositories(spark):
    text = "def f():\n    print(1)\n\ndef g():\n    pass\n"
    made = python_source.tables(files(spark, ("o/a", "setup.py", text), ("o/b", "setup.py", text)))
    facts = made["FunctionFact"].facts().orderBy("fact_order").collect()
    assert len({r.fact_id for r in facts}) == 4 and [r.name for r in facts] == ["f", "g", "f", "g"] and len({r.fact_order for r in facts}) == 4
    value = engine.evaluate(engine.CATALOG["ALL-CONT0003"], made).values.collect()
    assert sorted(r.integer_value for r in value) == [1, 1]


def test_only_the_relations_asked_for(spark):
    made = python_source.tables(files(spark, ("o/a", "a.py", "def f(x):\n    return g(x)\n")), ["function"])
    assert set(made) == {"FunctionFact"} and set(made["FunctionFact"].relations) == {"facts"} and made["FunctionFact"].facts().count() == 1


def test_no_blocking_call_is_listed_by_default(spark):
    made = python_source.tables(files(spark, ("o/a", "a.py", "requests.get('x')\n")))
    value = lambda **s: [r.integer_value for r in engine.evaluate(engine.CATALOG["ALL-CALL0002"], made, s).values.collect()]
    assert value() == [0] and value(bounded_callables=("requests.get",)) == [1]


def test_device_surfaces():
    from factloom.sources import surfaces

    text = "cudaStream_t s;\nvoid f() { k<<<1, 32>>>(a); k<<<dim3(1, 2), 32, 0, s>>>(a); cudaMemcpy(a, b, 1, x); __syncthreads(); }"
    assert surfaces.device(text) == {"barriers": 1, "default_launches": 1, "copies": 1}
    assert surfaces.device("void f() { k<<<1, 32>>>(a); cudaMemcpy(a, b, 1, x); }") == {"barriers": 0, "default_launches": 0, "copies": 0}


@pytest.mark.parametrize("name,want", [("APIToken", True), ("primary_api_key", False), ("password", True), ("key", False), ("token_path", False), ("cacheKey", False), ("apiKey", True), ("monkey", False)])
def test_secret_names(spark, name, want):
    from factloom.operators.text import secret_name
    from pyspark.sql import functions as F

    assert spark.range(1).select(secret_name(F.lit(name))).first()[0] == want


def test_every_binding_of_a_line_is_read(spark):
    from factloom.operators.text import credentials

    source = spark.createDataFrame([(1, 'a_b = "x"; db_password = "hunter2"; token = "<here>"\n', None)], "file_id long, text string, ingested_at timestamp")
    assert [(r.line, r.name) for r in credentials(source).collect()] == [(1, "db_password")]
