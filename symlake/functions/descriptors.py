"""Field and method descriptors, with the wildcards ``?`` (any type) and ``(*)?`` (any parameters)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlake.functions.flags import STATIC, VARARGS, has_flag
from symlake.functions.names import _col

# One type inside a descriptor, wildcard included.
TYPE_TOKEN = r"(\[*(?:L[^;]+;|[BCDFIJSZVXY?]))"

# Display text of the one-letter types (X and Y stand for undetermined ints).
PRIMITIVES = {
    "B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long",
    "S": "short", "V": "void", "X": "int", "Y": "int", "Z": "boolean",
}


def _params_text(c: Column) -> Column:
    return F.regexp_extract(c, r"^\(([^)]*)\)", 1)


def param_types(c) -> Column:
    return F.regexp_extract_all(_params_text(_col(c)), F.lit(TYPE_TOKEN), 1)


def descriptor_arity(c) -> Column:
    return F.size(param_types(c))


def return_type(c) -> Column:
    c = _col(c)
    return F.when(c.startswith("("), F.regexp_extract(c, r"\)(.*)$", 1)).otherwise(c)


def explode_descriptor(c) -> Column:
    """Struct ``param_types, arity, return_type``."""
    return F.struct(param_types(c).alias("param_types"), descriptor_arity(c).alias("arity"),
                    return_type(c).alias("return_type"))


def render_type(c, varargs=None) -> Column:
    """Readable type: package cut, ``$`` shown as ``.``, one ``[]`` per dimension (the last as ``...``)."""
    c = _col(c)
    base = F.ltrim(c, F.lit("["))
    dims = F.length(c) - F.length(base)
    names = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    cls = F.translate(F.substring_index(F.regexp_replace(base, "^L|;$", ""), "/", -1), "$", ".")
    name = F.when(base.startswith("L"), cls).otherwise(F.coalesce(F.try_element_at(names, base), base))
    plain = F.concat(name, F.repeat(F.lit("[]"), dims))
    if varargs is None:
        return plain
    spread = F.concat(name, F.repeat(F.lit("[]"), dims - 1), F.lit("..."))
    return F.when(varargs & (dims > 0), spread).otherwise(plain)


def render_field(name, descriptor) -> Column:
    return F.concat(_col(name), F.lit(" : "), render_type(descriptor))


def render_method(name, descriptor, flags, ctor_name, is_inner, type_flags) -> Column:
    """``name(a, b) : ret``; constructors show ``ctor_name`` and, for non-static inner types, hide the implicit
    outer parameter. A variable-arity array shows ``...`` unless it is the first parameter shown."""
    name, descriptor = _col(name), _col(descriptor)
    ctor = name == "<init>"
    declared = param_types(descriptor)
    hide_outer = ctor & _col(is_inner) & ~has_flag(type_flags, STATIC)
    shown = F.when(hide_outer, F.slice(declared, F.lit(2), F.size(declared))).otherwise(declared)
    spread = has_flag(flags, VARARGS)
    last = F.size(shown) - 1
    args = F.array_join(F.transform(
        shown, lambda t, i: render_type(t, spread & (i == last) & (i > 0))), ", ")
    call = F.concat(F.when(ctor, _col(ctor_name)).otherwise(name), F.lit("("), args, F.lit(")"))
    return (F.when(name == "<clinit>", "{...}")
            .when(ctor, call)
            .otherwise(F.concat(call, F.lit(" : "), render_type(return_type(descriptor)))))


def render_signature(kind, name, descriptor, flags, ctor_name, is_inner, type_flags) -> Column:
    return F.when(_col(kind) == "field", render_field(name, descriptor)).otherwise(
        render_method(name, descriptor, flags, ctor_name, is_inner, type_flags))


def types_match(a, b) -> Column:
    """Two descriptor types, either of which may be ``?`` or ``L*/Name;`` behind the same dimensions."""
    a, b = _col(a), _col(b)

    def covers(wild: Column, other: Column) -> Column:
        dims = F.regexp_extract(wild, r"^(\[*)", 1)
        tail = F.regexp_extract(wild, r"^\[*L\*(/.*)$", 1)
        return wild.rlike(r"^\[*L\*/") & other.startswith(F.concat(dims, F.lit("L"))) & (
            other.endswith(tail) | (other == F.concat(dims, F.lit("L"), F.substring(tail, 2, 1 << 30))))

    return (a == b) | (a == "?") | (b == "?") | covers(a, b) | covers(b, a)


def descriptors_match(a, b) -> Column:
    """Whole descriptors; a method never matches a field and ``(*)?`` matches every method."""
    a, b = _col(a), _col(b)
    methods = a.startswith("(") & b.startswith("(")
    fields = ~a.startswith("(") & ~b.startswith("(")
    any_params = a.startswith("(*") | b.startswith("(*")
    pa, pb = param_types(a), param_types(b)
    same_params = (F.size(pa) == F.size(pb)) & F.forall(
        F.zip_with(pa, pb, lambda x, y: types_match(x, y)), lambda ok: ok)
    # "any parameters" stands for any return type too.
    return (methods & (any_params | (same_params & types_match(return_type(a), return_type(b))))) | (
        fields & types_match(a, b))
