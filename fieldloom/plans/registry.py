"""The operators of field programs: ports, scalar configuration and result types."""

from __future__ import annotations

from dataclasses import dataclass

#: Names of declared types and how messages call them.
TYPES = {"scalar": "Scalar", "scalar_field": "ScalarField", "vector_field": "VectorField", "bool_field": "BoolField", "category_field": "CategoryField", "index_field": "IndexField", "network": "Network"}


@dataclass(frozen=True)
class Operator:
    id: str
    output: str
    ports: dict[str, str]
    #: Scalar configuration: required or not.
    config: dict[str, bool]


def _op(line: str) -> Operator:
    head, *rest = line.split()
    name, output = head.split(":")
    ports = dict(x.split(":") for x in rest if ":" in x)
    return Operator(name, output, ports, {x.rstrip("?"): not x.endswith("?") for x in rest if ":" not in x})


#: Id:output, then port:type, then configuration, with ? where it may be left out.
OPERATORS = {
    o.id: o
    for o in map(
        _op,
        """
constant:scalar_field value
noise:scalar_field scale?
correlated_noise:scalar_field radius amplitude? mean?
voronoi_labels:category_field count
pointwise:scalar_field
vector_expr:vector_field
neighbor_sample:scalar_field field:scalar_field
smooth_radius:scalar_field field:scalar_field radius
gradient:vector_field field:scalar_field
laplacian:scalar_field field:scalar_field
diffuse:scalar_field field:scalar_field rate iterations
advect:scalar_field field:scalar_field velocity:vector_field
boundary_strength:scalar_field labels:category_field
region_scalar:scalar_field labels:category_field scale? offset?
boundary_signed_difference:scalar_field labels:category_field values:scalar_field scale?
distance_to_mask:scalar_field mask:bool_field
flow_direction:index_field potential:scalar_field
accumulate:scalar_field receivers:index_field values:scalar_field
network_threshold:network field:scalar_field threshold
reduce:scalar values:scalar_field
threshold:bool_field field:scalar_field threshold
vector_dot:scalar_field a:vector_field b:vector_field
vector_magnitude:scalar_field field:vector_field
region_vector:vector_field labels:category_field magnitude
boundary_normal_component:scalar_field labels:category_field velocity:vector_field
boundary_tangential_component:scalar_field labels:category_field velocity:vector_field
divergence:scalar_field field:vector_field
vector_add:vector_field a:vector_field b:vector_field
vector_subtract:vector_field a:vector_field b:vector_field
scalar_vector_multiply:vector_field scalar:scalar_field vector:vector_field
""".strip().splitlines(),
    )
}
