"""Every global name that a function of the package uses is there, also in code that no other test calls."""

import builtins
import dis
import importlib
import pkgutil
import types

import topicloom


def _codes(code):
    yield code
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            yield from _codes(inner)


def _missing(module):
    source = importlib.util.find_spec(module.__name__).loader.get_code(module.__name__)
    known = set(vars(module)) | set(vars(builtins))
    return {i.argval for code in _codes(source) for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"} - known


def test_no_function_uses_a_name_that_is_not_defined():
    found = {}
    for info in pkgutil.walk_packages(topicloom.__path__, "topicloom."):
        module = importlib.import_module(info.name)
        if names := _missing(module):
            found[info.name] = names
    assert not found
