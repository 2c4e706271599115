import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# The two snippets the answers are known for.
SAMPLE = '''
def hello_world():
    print("Hello, world!")
    
def complex_function(data):
    result = 0
    for i in range(10):
        for j in range(10):
            result += i * j
    return result
'''

VULNERABLE = '''
import os

def run_command(user_input):
    # Vulnerable to command injection
    os.system("echo " + user_input)
    
    # Vulnerable to eval
    data = eval(user_input)
    return data
'''


@pytest.fixture(scope="session")
def spark():
    from lintlake.session import local_session

    session = local_session("8", "tests", tempfile.mkdtemp(prefix="run-"))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_code(spark):
    from lintlake.schemas import CODE

    def make(*snippets):
        rows = [(str(i), None, language, text, None, None, None) for i, (language, text) in enumerate(snippets)]
        return spark.createDataFrame(rows, CODE)

    return make
