"""Scene documents by hand: sections, what is wrong with them, and values outside their domains."""

from tessera.sources import scenes

GOOD = """<?xml version="1.0"?>
<DynamicsSystem xmlns="SceneFile">
  <SceneSettings>
    <RecorderSettings><Visualization/></RecorderSettings>
    <!-- <Unknown/> -->
    <TimeStepperSettings deltaT="0.1"/>
    <ContactParameterMap/>
  </SceneSettings>
  <SceneObjects kind="x">
    <RigidBodies instances="3"><Geometry><Sphere radius="1"/></Geometry></RigidBodies>
    <RigidBodies instances="2"/>
  </SceneObjects>
</DynamicsSystem>"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, xml string")


def test_sections(spark):
    found = {(r.parent, r.section): r["count"] for r in scenes.sections(docs(spark, GOOD)).collect()}
    assert {k[1]: v for k, v in found.items() if v} == {"RecorderSettings": 1, "TimeStepperSettings": 1, "ContactParameterMap": 1, "RigidBodies": 2}
    assert len(found) == 10 and scenes.violations(docs(spark, GOOD)).count() == 0


def test_violations(spark):
    bad = GOOD.replace("<ContactParameterMap/>", "<TimeStepperSettings/><Extra><RigidBodies/></Extra>")
    empty = "<DynamicsSystem/>"
    rows = scenes.violations(docs(spark, bad, empty)).collect()
    assert {(r.section, r.wrong) for r in rows if r.id == 0} == {("ContactParameterMap", "missing"), ("TimeStepperSettings", "repeated"), ("Extra", "unknown")}
    assert {(r.section, r.wrong) for r in rows if r.id == 1} == {(s, "missing") for s in ("RecorderSettings", "TimeStepperSettings", "ContactParameterMap", "RigidBodies")}


def test_domains(spark):
    bad = GOOD.replace('instances="2"', 'instances="-2"').replace('radius="1"', 'radius="0"')
    domains = {"//RigidBodies/@instances": "nonNegativeInt", "//Sphere/@radius": "positiveDouble", "//TimeStepperSettings/@deltaT": "positiveDouble"}
    assert {(r.path, r.value) for r in scenes.domain_violations(docs(spark, bad), domains).collect()} == {("//RigidBodies/@instances", "-2"), ("//Sphere/@radius", "0")}
