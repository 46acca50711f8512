import pytest

from tallyloom.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    s = get_spark(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir=str(root / "warehouse"), spark__checkpoint__dir=f"file://{root}/shared")
    s.sparkContext.setLogLevel("ERROR")
    return s
