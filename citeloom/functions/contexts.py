"""Keys under which facts of a policy are kept for later applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field that was extracted, category, key. A key alone isn't unique.
CONTEXT_KEYS = """
insuredName company_info company_name
insuredDba company_info dba_name
insuredAddress company_info company_address
insuredEntityType company_info entity_type
insuredFein company_info fein
insuredSicCode company_info sic_code
insuredNaicsCode company_info naics_code
classifications[].description operations description_of_operations
classifications[].basisAmount(payroll) operations annual_payroll
classifications[].basisAmount(revenue) operations annual_revenue
totalPremium financial current_premium
locations[].buildingValue financial total_property_values
locations[].contentsValue financial total_contents_values
linesOfBusiness coverage coverage_types
coverages[].limit coverage current_limits
coverages[].deductible coverage current_deductibles
experienceMod.factor loss_history experience_mod
lossSummary.totalClaims loss_history total_claims
locations[] premises premises_addresses
locations[].constructionType premises construction_type
locations[].yearBuilt premises year_built
locations[].sprinklered premises sprinkler_system
vehicles[] vehicles vehicle_schedule
vehicles[].length vehicles vehicle_count
classifications[](WC) employees employee_count_by_class
classifications[].basisAmount(payroll,byState) employees annual_payroll_by_state
declarations.dwelling.yearBuilt property_info year_built
declarations.dwelling.constructionType property_info construction_type
declarations.dwelling.squareFootage property_info square_footage
declarations.dwelling.roofType property_info roof_type
declarations.dwelling.roofAge property_info roof_age
declarations.dwelling.stories property_info num_stories
declarations.dwelling.heatingType property_info heating_type
declarations.dwelling.protectiveDevices property_info protective_devices
declarations.coverageA coverage dwelling_coverage_limit
declarations.coverageE coverage personal_liability_limit
declarations.drivers[].name driver_info driver_names
declarations.drivers[].licenseNumber driver_info driver_license_numbers
declarations.vehicles[].vin vehicle_info vehicle_vins
declarations.vehicles[].annualMileage vehicle_info annual_mileage
declarations.floodZone property_info flood_zone
declarations.elevationCertificate property_info has_elevation_cert
declarations.mortgagee.name financial mortgagee_name
insuredAddress company_info primary_residence_address
declarations.petName pet_info pet_name
declarations.species pet_info pet_species
declarations.breed pet_info pet_breed
"""


def context_table(spark: SparkSession) -> DataFrame:
    """field, category, context_key: some fifty rows, to be broadcast."""
    return spark.createDataFrame([tuple(x.split(" ")) for x in CONTEXT_KEYS.strip().split("\n")], "field string, category string, context_key string")


def context_values(facts: DataFrame) -> DataFrame:
    """facts(.., field): with category and context_key, one row for each mapping of the field; unmapped fields go."""
    return facts.join(F.broadcast(context_table(facts.sparkSession)), "field")


def context_key(section: Column, label: Column) -> Column:
    """A stable key of an application's field."""
    said = F.regexp_replace(F.lower(F.trim(F.concat(section, F.lit("."), label))), "[^a-z0-9]+", "_")
    return F.regexp_replace(said, r"^_+|_+\z", "")
