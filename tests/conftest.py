import contextlib
import io
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan_of():
    """The physical plan of a frame as text, before it runs."""

    def text(df) -> str:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            df.explain("formatted")
        return shown.getvalue()

    return text


@pytest.fixture
def texts(spark):
    def frame(*values, first=0):
        return spark.createDataFrame(
            [(first + i, v) for i, v in enumerate(values)], "doc_id bigint, text string"
        )

    return frame


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture(name="rows", scope="session")
def rows_fixture():
    return rows
